"""Full-text search over the email corpus for many requests in one job.

* ``posting_lists``: one row per (term, message_id) with the sorted places of
  the term in the message, built inside the message's row without a shuffle;
  ``flat`` gives one row per (term, message_id, field, pos).  Tokens are
  case-folded, accent-folded runs of letters and digits.
* Phrase match: every keyword is a phrase; all keywords of a request must
  match, each inside one field (different keywords may hit different fields).
* Candidates first: the messages that hold a request's rarest term (by the
  number of messages per term) are its candidates; those that pass its filters
  are written once.  Only (term, message) pairs of these are then looked up: a filter of ``FILTER_BITS`` bits over these
  pairs is made at run time and stands at the scan of the lists, so a term that
  half the corpus holds sends on no more rows than there are candidates (and a
  few false hits, which the join drops).  Phrases are verified on the places of
  what is left.  No message text is read before the snippets of the final
  results.
* Filters: inbox (sender or any recipient), optional sender, optional
  recipient, half-open date interval on the ``yyyy-MM-dd HH:mm:ss`` text.  A
  filter that is null or empty is not set; without a limit there are 10 results.
* Top-k per request by date descending (message_id breaks ties); Spark plans
  the ``row_number() <= k`` filter as a partial ``WindowGroupLimit`` before
  the exchange, so a request that matches a third of the corpus still ships
  at most k rows per map task.

No side is broadcast by a hint: Spark decides from measured sizes.  Stored
lists are in folders by term bucket, so a join on (bucket, term) can skip the
folders of unused buckets at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import TOKEN_SPAN, fts_tokens
from ..session import cut_lineage

#: Folders of the stored lists; each holds as many files as the range dealing gives it.
TERM_BUCKETS = 32
#: Bits of the run-time filter (128 KiB); fuller filters let more rows by, never fewer.
FILTER_BITS = 1 << 20
FIELDS = ("subject", "body")


def term_bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def _tokens(field: str, no: int) -> Column:
    """(term, place) of a field's tokens; the field's number is in the place's high bits."""
    return F.transform(F.coalesce(fts_tokens(field), F.array().cast("array<string>")),
                       lambda t, i: F.struct(t.alias("term"), (F.lit(no << 32) + i).cast("long").alias("place")))


def posting_lists(emails: DataFrame, fields=FIELDS) -> DataFrame:
    """(term, message_id, places): the sorted places of each term in a message.
    The message's tokens are sorted and cut where the term changes."""
    rows = emails.select("message_id", F.sort_array(F.concat(*[_tokens(f, i) for i, f in enumerate(fields)])).alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1),
                     lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"]))
    rows = rows.filter(F.size("s") > 0).withColumn("first", first)
    lists = F.transform("first", lambda a, j: F.struct(
        F.get("s", a)["term"].alias("term"),
        F.transform(F.slice("s", a + 1, F.coalesce(F.get("first", j + 1), F.size("s")) - a), lambda x: x["place"]).alias("places")))
    return rows.select("message_id", F.inline(lists)).select("term", "message_id", "places")


def packed_lists(emails: DataFrame, fields=FIELDS) -> DataFrame:
    """(bucket, message_id, packed): the posting lists of a message by term
    bucket, one text of 'term place place ...' lines each, without a shuffle; so
    a message's lists are dealt out in at most ``TERM_BUCKETS`` short rows."""
    place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)) * len(fields) + F.shiftright(x, 32)
    rows = emails.select("message_id", F.sort_array(F.concat(*[F.transform(_tokens(f, i), lambda t: F.struct(
        term_bucket(t["term"]).alias("bucket"), t["term"].alias("term"), place(t["place"]).alias("place"))) for i, f in enumerate(fields)])).alias("s"))
    line = lambda x, i: F.concat(
        F.when(i == 0, F.lit("")).when(F.get("s", i - 1)["bucket"] != x["bucket"], F.lit("\n\n"))
        .when(F.get("s", i - 1)["term"] != x["term"], F.lit("\n")).otherwise(F.lit(" ")),
        F.when((i == 0) | (F.get("s", i - 1)["term"] != x["term"]), F.concat(x["term"], F.lit(" "))).otherwise(F.lit("")), x["place"].cast("string"))
    texts = F.split(F.array_join(F.transform("s", line), ""), "\n\n", -1)
    buckets = F.array_distinct(F.transform("s", lambda x: x["bucket"]))
    rows = rows.filter(F.size("s") > 0).select("message_id", F.inline(F.arrays_zip(buckets.alias("bucket"), texts.alias("packed"))))
    return rows.select("bucket", "message_id", "packed")


def unpacked(packed: DataFrame, fields=FIELDS) -> DataFrame:
    """(term, message_id, places, bucket) of ``packed_lists``."""
    words = packed.select("bucket", "message_id", F.explode(F.split("packed", "\n", -1)).alias("line")).select("bucket", "message_id", F.split("line", " ", -1).alias("w"))
    n = len(fields)
    places = F.expr(f"transform(slice(w, 2, size(w) - 1), x -> shiftleft(cast(x as long) % {n}, 32) + cast(x as long) div {n})")
    return words.select(F.get("w", F.lit(0)).alias("term"), "message_id", F.array_sort(places).alias("places"), "bucket")


def flat(lists: DataFrame, fields=FIELDS) -> DataFrame:
    """(message_id, field, pos, term) of posting lists."""
    place = F.col("place")
    return lists.select("message_id", "term", F.explode("places").alias("place")).select(
        "message_id", F.get(F.array(*map(F.lit, fields)), F.shiftright(place, 32).cast("int")).alias("field"),
        place.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), "term")


def postings(emails: DataFrame, fields=FIELDS) -> DataFrame:
    """One row per token: (message_id, field, pos, term)."""
    arr = F.array(*[F.struct(F.lit(f).alias("field"), fts_tokens(f).alias("tokens")) for f in fields])
    return (emails.select("message_id", F.explode(arr).alias("f"))
            .select(F.col("message_id"), F.col("f.field").alias("field"),
                    F.posexplode("f.tokens").alias("pos", "term")))


def _set(x) -> Column:
    """The filter's value, null when it is not set (null or empty)."""
    return F.nullif(F.col(x), F.lit(""))


def validate_requests(requests: DataFrame, max_results: str = "max_results") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with ``reject_reason``). A request needs at least one
    keyword, every keyword needs a token, and at most MAX_SEARCH_RESULTS
    results."""
    no_token = F.exists(F.coalesce("keywords", F.array().cast("array<string>")),
                        lambda k: F.coalesce(F.size(fts_tokens(k)), F.lit(0)) <= 0)
    reason = (F.when(F.coalesce(F.size("keywords"), F.lit(0)) <= 0, F.lit("no keywords"))
              .when(no_token, F.lit("keyword without searchable token"))
              .when(F.col(max_results) > K.MAX_SEARCH_RESULTS, F.lit("max_results must be <= 10")))
    tagged = requests.withColumn("reject_reason", reason)
    return (tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.filter(F.col("reject_reason").isNotNull()))


def rejections(requests: DataFrame) -> DataFrame:
    """(request_id, reject_reason) of the requests that ``search`` does not answer."""
    return validate_requests(requests)[1].select("request_id", "reject_reason")


def request_terms(requests: DataFrame) -> DataFrame:
    kw = requests.select("request_id", F.posexplode("keywords").alias("kw_idx", "keyword"))
    kw = kw.withColumn("tokens", fts_tokens("keyword"))
    return kw.select("request_id", "kw_idx", F.size("tokens").alias("n_terms"),
                     F.posexplode("tokens").alias("term_idx", "term"))


def parties(emails: DataFrame, recipients: DataFrame, addresses: DataFrame) -> DataFrame:
    """(message_id, party) of the messages that one of the ``addresses`` (column
    address) sent or got, once each: 'sender = x OR EXISTS recipient = x' as two
    semi joins by address.  Only mail of these addresses is compared for copies;
    null addresses have no mail."""
    asked = addresses.select(F.col("address").alias("party")).distinct()
    sent = emails.select("message_id", F.col("from_address").alias("party")).join(asked, "party", "left_semi")
    got = recipients.select(F.col("email_id").alias("message_id"), F.col("recipient_address").alias("party")).join(asked, "party", "left_semi")
    return sent.unionByName(got).distinct()


def _keys(lists: DataFrame) -> list[str]:
    return ["bucket", "term"] if "bucket" in lists.columns else ["term"]


def term_stats(lists: DataFrame) -> DataFrame:
    """(term, n): messages per term (map-side partial counts)."""
    return lists.groupBy(*_keys(lists)).agg(F.count(F.lit(1)).alias("n"))


def candidates(lists: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(request_id, message_id) of messages holding the request's rarest
    term: a message that matches every phrase must hold every term, so the
    rarest one bounds the candidates. A frequent term never drives the join
    unless all of a request's terms are frequent.  Lists and counts of other
    terms are left out at their scans."""
    keys = _keys(lists)
    stats = stats.filter(key_filter(terms, ["term"]))
    with_n = terms.join(stats, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchor = with_n.groupBy("request_id").agg(F.min_by(F.struct(*keys), F.struct("n", "term")).alias("a"))
    anchor = anchor.select("request_id", *[F.col(f"a.{k}").alias(k) for k in keys])
    near = lists.select(*keys, "message_id").filter(key_filter(anchor, ["term"]))
    return near.join(anchor, keys).select("request_id", "message_id")


def key_filter(keys: DataFrame, cols: list[str], bits: int = FILTER_BITS) -> Column:
    """Condition that holds for every row whose ``cols`` occur in ``keys`` and
    for few others, as a scalar subquery that a scan's filter can use: one bit
    per hash value, in an array of fixed size."""
    at = F.pmod(F.xxhash64(*cols), F.lit(bits).cast("long"))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    every = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    array = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("set", F.lit(0)).cast("long").alias("set")))).alias("a"))
    table = array.select(F.col("a.set").alias("a")).scalar()
    return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def candidate_lists(lists: DataFrame, cand: DataFrame, terms: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(request_id, message_id, kw_idx, n_terms, term_idx, places): the lists of
    a request's terms in its candidates (request_id, message_id)."""
    wanted = terms.join(cand.select("request_id", "message_id"), "request_id")
    near = lists.filter(key_filter(wanted, ["term", "message_id"], bits))
    return near.join(wanted, [*_keys(lists), "message_id"]).select("request_id", "message_id", "kw_idx", "n_terms", "term_idx", "places")


def matches(lists: DataFrame, cand: DataFrame, terms: DataFrame) -> DataFrame:
    """(request_id, message_id, n_phrases): how many of the request's phrases a
    candidate holds, if any: the terms of a phrase stand at consecutive places
    of one field.  A candidate's lists (as many as its request has terms) are
    shuffled once; starts and phrases are counted in that partitioning."""
    held = candidate_lists(lists, cand, terms)
    # a term alone is a phrase wherever it stands
    places = F.when(F.col("n_terms") == 1, F.slice("places", 1, 1)).otherwise(F.col("places"))
    held = held.repartition("request_id", "message_id").select("request_id", "message_id", "kw_idx", "n_terms", "term_idx", F.explode(places).alias("place"))
    start = (F.col("place") - F.col("term_idx")).alias("start")
    phrase = held.groupBy("request_id", "message_id", "kw_idx", "n_terms", start).agg(F.count(F.lit(1)).alias("n")).filter("n = n_terms")
    phrase = phrase.select("request_id", "message_id", "kw_idx").distinct()
    return phrase.groupBy("request_id", "message_id").agg(F.count(F.lit(1)).alias("n_phrases"))


def _date_bounds(emails: DataFrame, requests: DataFrame) -> DataFrame:
    """Emails inside the dates that all requests together span, as a filter
    that the scan can use (every date when a request leaves a side open)."""
    after, before = _set("sent_after"), _set("sent_before")
    span = requests.agg(
        F.coalesce(F.when(F.count(after) == F.count(F.lit(1)), F.concat(F.min(after), F.lit(" 00:00:00"))), F.lit("")).alias("lo"),
        F.coalesce(F.when(F.count(before) == F.count(F.lit(1)), F.concat(F.max(before), F.lit(" 00:00:00"))), F.lit("~")).alias("hi"))
    return emails.filter((F.col("date") >= span.select("lo").scalar()) & (F.col("date") < span.select("hi").scalar()))


def apply_filters(cand: DataFrame, recipients: DataFrame) -> DataFrame:
    """Rows (request_id, message_id, date, from_address, inbox, from_addr,
    to_addr, sent_after, sent_before, ...) that pass the request's filters.
    Recipients are looked up once, for the inbox and the recipient filter of
    the rows that pass the others."""
    sender, to, after, before = map(_set, ("from_addr", "to_addr", "sent_after", "sent_before"))
    cand = cand.filter((sender.isNull() | (F.col("from_address") == sender))
                       & (after.isNull() | (F.col("date") >= F.concat(after, F.lit(" 00:00:00"))))
                       & (before.isNull() | (F.col("date") < F.concat(before, F.lit(" 00:00:00")))))
    asked = F.array(F.struct(F.lit("inbox").alias("kind"), F.col("inbox").alias("addr")),
                    F.struct(F.lit("to").alias("kind"), to.alias("addr")))
    asked = cand.select("request_id", "message_id", F.inline(asked)).filter("addr is not null")
    held = recipients.select(F.col("email_id").alias("message_id"), F.col("recipient_address").alias("addr"))
    held = asked.join(held, ["message_id", "addr"]).groupBy("request_id", "message_id").agg(
        F.bool_or(F.col("kind") == "inbox").alias("_in"), F.bool_or(F.col("kind") == "to").alias("_to"))
    cand = cand.join(held, ["request_id", "message_id"], "left")
    return cand.filter(((F.col("from_address") == F.col("inbox")) | F.col("_in")) & (to.isNull() | F.col("_to"))).drop("_in", "_to")


FILTERS = ("inbox", "from_addr", "to_addr", "sent_after", "sent_before")


def search(emails: DataFrame, recipients: DataFrame, requests: DataFrame,
           lists: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Batch form of the filtered top-k search. ``requests`` columns:
    request_id, inbox, keywords, from_addr, to_addr, sent_after, sent_before,
    max_results. Returns request_id, rank, message_id, date.  Requests that are
    not valid have no results; ``rejections`` says why."""
    valid = cut_lineage(validate_requests(requests)[0])
    lists = lists if lists is not None else posting_lists(emails)
    stats = stats if stats is not None else term_stats(lists)
    terms = request_terms(valid)
    if "bucket" in lists.columns:
        terms = terms.withColumn("bucket", term_bucket(F.col("term")))
    meta = valid.select("request_id", *FILTERS, F.coalesce("max_results", F.lit(K.MAX_SEARCH_RESULTS)).alias("max_results"),
                        F.size("keywords").cast("long").alias("n_phrases"))
    mail = _date_bounds(emails.select("message_id", "from_address", "date"), valid)
    cand = candidates(lists, stats, terms).join(meta, "request_id").join(mail, "message_id")
    cand = cut_lineage(apply_filters(cand, recipients).select("request_id", "message_id", "date", "max_results", "n_phrases"))
    cand = matches(lists, cand, terms).join(cand, ["request_id", "message_id", "n_phrases"])
    w = Window.partitionBy("request_id").orderBy(F.col("date").desc(), F.col("message_id"))
    # the literal cap lets Spark plan a partial WindowGroupLimit before the
    # exchange; the per-request limit (<= the cap) is applied after it
    ranked = (cand.withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= K.MAX_SEARCH_RESULTS)
              .filter(F.col("rank") <= F.col("max_results")))
    return ranked.select("request_id", "rank", "message_id", "date")


def inbox_messages(emails: DataFrame, recipients: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, message_id) of the mail in each request's inbox that passes
    its other filters; keywords are not looked at."""
    visible = parties(emails, recipients, requests.select(F.col("inbox").alias("address")))
    own = requests.select("request_id", *FILTERS).join(visible, F.col("inbox") == F.col("party")).drop("party")
    mail = _date_bounds(emails.select("message_id", "from_address", "date"), requests)
    return apply_filters(own.join(mail, "message_id"), recipients).select("request_id", "message_id")


def snippets(results: DataFrame, requests: DataFrame, emails: DataFrame, width: int = K.SNIPPET_TOKENS) -> DataFrame:
    """Snippet per result: the field with a match (subject preferred), a
    window of ``width`` tokens of the source text from the earliest match, each
    matched run marked once with <b>...</b>, ' ... ' where the window cuts the
    field.  (Fragment choice differs from SQLite's scoring heuristic; this one
    is 'earliest match'.) Works on the <= k results per request only."""
    kw = requests.select("request_id", F.explode("keywords").alias("keyword"))
    phrases = kw.groupBy("request_id").agg(F.collect_list(fts_tokens("keyword")).alias("phrases"))
    j = results.join(phrases, "request_id").join(emails.select("message_id", "subject", "body"), "message_id")

    def covered(tok_col):
        def starts(p):
            n = F.size(p)
            return F.when(F.size(tok_col) >= n, F.filter(F.sequence(F.lit(0), F.size(tok_col) - n),
                                                          lambda i: F.slice(tok_col, i + 1, n) == p)) \
                .otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.flatten(F.transform("phrases", lambda p: F.flatten(
            F.transform(starts(p), lambda i: F.sequence(i, i + F.size(p) - 1))))))

    j = j.withColumns({"_st": fts_tokens("subject"), "_bt": fts_tokens("body")})
    j = j.withColumns({"_sh": covered(F.col("_st")), "_bh": covered(F.col("_bt"))})
    use_subject = F.size("_sh") > 0
    source = F.when(use_subject, F.col("subject")).otherwise(F.col("body"))
    # the words as written, and what stands before each of them
    j = j.withColumns({
        "field": F.when(use_subject, F.lit("subject")).otherwise(F.lit("body")),
        "hset": F.when(use_subject, F.col("_sh")).otherwise(F.col("_bh")),
        "words": F.regexp_extract_all(source, F.lit(TOKEN_SPAN), 0),
        "gaps": F.split(source, TOKEN_SPAN, -1),
    }).withColumn("first", F.array_min("hset"))

    def shown(word, i):
        at = F.col("first") + i
        hit = F.array_contains("hset", at)
        opens = hit & ((i == 0) | ~F.array_contains("hset", at - 1))
        closes = hit & ((i == width - 1) | ~F.array_contains("hset", at + 1))
        return F.concat(F.when(i > 0, F.get("gaps", at)).otherwise(F.lit("")),
                        F.when(opens, F.lit(K.SNIPPET_OPEN)).otherwise(F.lit("")), word,
                        F.when(closes, F.lit(K.SNIPPET_CLOSE)).otherwise(F.lit("")))
    window = F.transform(F.slice("words", F.col("first") + 1, width), shown)
    text = F.concat(F.when(F.col("first") > 0, F.lit(K.SNIPPET_ELLIPSIS)).otherwise(F.lit("")),
                    F.array_join(window, ""),
                    F.when(F.col("first") + width < F.size("words"), F.lit(K.SNIPPET_ELLIPSIS)).otherwise(F.lit("")))
    return j.select(*results.columns, "field", text.alias("snippet"))


def scenario_requests(scen: DataFrame) -> DataFrame:
    """The search tool bound to a scenario: its inbox, its keywords, mail
    dated before its query date, 10 results."""
    return scen.select(
        F.col("id").alias("request_id"),
        F.col("inbox_address").alias("inbox"),
        "keywords",
        F.lit(None).cast("string").alias("from_addr"),
        F.lit(None).cast("string").alias("to_addr"),
        F.lit(None).cast("string").alias("sent_after"),
        F.col("query_date").alias("sent_before"),
        F.lit(K.MAX_SEARCH_RESULTS).alias("max_results"),
    )
