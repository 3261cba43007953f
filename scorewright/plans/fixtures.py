"""Stand-in inputs derived from the driver tables (see FIXTURES.md §D).

Each fixture is a pure expression over one or two tables, so its size grows
with the tables and DuckDB can rebuild the same rows for the oracle
(``plans/oracle.py`` holds the SQL twins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..sources.tables import read_table

WORKING = K.REASONING_START + "Let me think step by step." + K.REASONING_END


def _s(x) -> Column:
    return x.cast("string")


def _decimal2(cents: Column) -> Column:
    """Non-negative integer cents as 'units.cc' text (same text in any engine)."""
    return F.concat(_s(F.floor(cents / 100)), F.lit("."), F.lpad(_s(cents % 100), 2, "0"))


def _thousands(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(_s(F.floor(n / 1000)), F.lit(","), F.lpad(_s(n % 1000), 3, "0"))).otherwise(_s(n))


def math_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored completions of a math task: 4 generations per prompt, twelve
    completion shapes by ``o_orderkey % 12``."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"], key="o_orderkey")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    a = _s(cust)
    sol = lambda body: F.concat(F.lit(WORKING + K.SOLUTION_START), body, F.lit(K.SOLUTION_END))
    v = k % 12
    completion = (
        F.when(v == 0, sol(a))
        .when(v == 1, F.concat(F.lit(WORKING + K.SOLUTION_START + " "), a, F.lit(" " + K.SOLUTION_END + K.DEFAULT_EOS)))
        .when(v == 2, sol(_decimal2(cust * 105)))
        .when(v == 3, sol(_decimal2(cust * 115)))
        .when(v == 4, sol(_s(cust * 2)))
        .when(v == 5, sol(F.lit("forty two")))
        .when(v == 6, F.concat(F.lit(WORKING), a))
        .when(v == 7, F.concat(sol(a), F.lit(K.SOLUTION_START), a, F.lit(K.SOLUTION_END)))
        .when(v == 8, sol(_thousands(cust)))
        .when(v == 9, F.concat(sol(a), F.lit("\nHope this helps.")))
        .when(v == 10, F.concat(F.lit(K.REASONING_START + "Let me think." + K.SOLUTION_START), a, F.lit(K.SOLUTION_END)))
        .otherwise(sol(F.lit("0")))
    )
    return o.select(
        F.floor(k / 4).alias("prompt_id"),
        (k % 4).cast("int").alias("gen_idx"),
        v.cast("int").alias("variant"),
        a.alias("answer"),
        completion.alias("completion"),
        F.col("o_orderdate").alias("event_time"),
    )


def _addr(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), _s(n), F.lit("@ex.com"))


def email_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed email records built from ``documents`` (texts repeat, so dedup
    has work; 31 bcc recipients when ``doc_id % 97 = 0``; empty and null
    addresses in some cc arrays)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"], key="doc_id")
    i = F.col("doc_id")
    cc = (F.when(i % 3 == 0, F.array(_addr("u", i % 5), F.lit("")))
          .when(i % 3 == 1, F.array(F.lit(None).cast("string")))
          .otherwise(F.array().cast("array<string>")))
    bcc = (F.when(i % 97 == 0, F.transform(F.sequence(F.lit(1), F.lit(31)), lambda n: _addr("b", n)))
           .when(i % 4 == 0, F.array(_addr("u", i % 13)))
           .otherwise(F.array().cast("array<string>")))
    return d.select(
        F.concat(F.lit("m"), _s(i)).alias("message_id"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.concat("lang", F.lit("@ex.com")).alias("from"),
        F.array(_addr("u", i % 7), _addr("u", (i + 3) % 11)).alias("to"),
        cc.alias("cc"),
        bcc.alias("bcc"),
        F.timestamp_add("HOUR", i, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).alias("date"),
        F.col("text").alias("body"),
        F.concat("source", F.lit("/"), _s(i)).alias("file_name"),
        i.alias("ordinal"),
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation scenarios from ``benchmark`` passages: the keywords are a
    word and a two-word phrase of the passage, so they occur in the documents
    that quote it."""
    from ..functions.text import fts_tokens

    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"]).withColumn("_tok", fts_tokens("text"))
    i = F.col("item_id")
    tok = F.col("_tok")
    ids = F.array(*[F.concat(F.lit("m"), _s((i * m) % 200)) for m in (13, 17, 19)])
    return b.select(
        i.alias("id"),
        F.concat(F.lit("Which message mentions "), F.try_element_at(tok, F.lit(2)), F.lit("?")).alias("question"),
        F.substring("text", 1, 40).alias("answer"),
        F.slice(ids, 1, (i % 3 + 1).cast("int")).alias("message_ids"),
        ((i % 10) / 10.0).cast("float").alias("how_realistic"),
        _addr("u", i % 7).alias("inbox_address"),
        F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), ((i * 37) % 420).cast("int")), "yyyy-MM-dd").alias("query_date"),
        F.when(i % 4 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.array(F.try_element_at(tok, F.lit(2)),
                F.concat_ws(" ", F.try_element_at(tok, F.lit(4)), F.try_element_at(tok, F.lit(5)))).alias("keywords"),
    )


def _q(x: Column) -> Column:
    """JSON string literal of a plain text value (no quotes/backslashes in it)."""
    return F.concat(F.lit('"'), x, F.lit('"'))


def _json_obj(pairs: list[tuple[str, Column]], trailing_comma: bool = False) -> Column:
    parts = []
    for i, (k, v) in enumerate(pairs):
        parts += [F.lit(("," if i else "") + f'"{k}":'), v]
    return F.concat(F.lit("{"), *parts, F.lit(",}" if trailing_comma else "}"))


def ie_gold_pairs(o_cols=None) -> list[tuple[str, Column]]:
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    filing = F.to_date("o_orderdate")
    v = k % 10
    published = F.when(v == 5, F.date_sub(filing, 30)).otherwise(F.date_add(filing, 30))
    d = lambda x: _q(F.date_format(x, "yyyy-MM-dd"))
    decision = (F.when(F.col("o_orderstatus") == "F", "ACCEPTED")
                .when(F.col("o_orderstatus") == "O", "PENDING").otherwise("REJECTED"))
    summary = F.when(k % 3 == 0, F.lit("null")).otherwise(_q(F.concat(F.lit("Summary of order "), _s(k))))
    claims = F.concat(F.lit("["), _q(F.concat(F.lit("Claim about part "), _s(k % 50))), F.lit(","),
                      _q(F.concat(F.lit("Second claim for "), _s(cust))), F.lit("]"))
    return [
        ("publication_number", _q(F.concat(F.lit("US"), _s(k), F.lit("A1")))),
        ("application_number", _q(F.concat(_s(cust), F.lit("/"), _s(k)))),
        ("patent_number", _q(_s(k * 7))),
        ("date_published", d(published)),
        ("filing_date", d(filing)),
        ("patent_issue_date", d(F.date_add(filing, 400))),
        ("abandon_date", F.lit('""')),
        ("decision", _q(decision)),
        ("main_cpc_label", _q(F.col("o_orderpriority"))),
        ("main_ipcr_label", _q(F.concat(F.lit("G06F"), _s(k % 100)))),
        ("title", _q(F.concat(F.lit("Order "), _s(k), F.lit(" for customer "), _s(cust)))),
        ("abstract", _q(F.concat(F.lit("Total price "), _s(F.floor("o_totalprice"))))),
        ("summary", summary),
        ("claims", claims),
    ]


def ie_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records and one stored completion each; ten completion shapes by
    ``o_orderkey % 10``: 0 exact JSON, 1 wrapped in prose, 2 missing key,
    3 extra key, 4 yyyy/MM/dd date, 5 gold dates out of order, 6 trailing
    comma, 7 top-level array, 8 no brace, 9 unbalanced first brace."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
                   key="o_orderkey")
    pairs = ie_gold_pairs()
    gold = _json_obj(pairs)
    no_claims = _json_obj([p for p in pairs if p[0] != "claims"])
    extra = _json_obj([("note", F.lit('"extra"'))] + pairs)
    slash = _json_obj([(n, _q(F.date_format(F.to_date("o_orderdate"), "yyyy/MM/dd")) if n == "filing_date" else v)
                       for n, v in pairs])
    v = F.col("o_orderkey") % 10
    completion = (
        F.when(v.isin(0, 5), gold)
        .when(v == 1, F.concat(F.lit("Here is the extracted record: "), gold, F.lit(" Let me know if you need more.")))
        .when(v == 2, no_claims)
        .when(v == 3, extra)
        .when(v == 4, slash)
        .when(v == 6, _json_obj(pairs, trailing_comma=True))
        .when(v == 7, F.concat(F.lit("["), gold, F.lit("]")))
        .when(v == 8, F.lit("No JSON here, sorry."))
        .otherwise(F.concat(F.lit('{"note": 1, '), gold))
    )
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.floor(F.col("o_orderkey") / 4).alias("prompt_id"),
        v.cast("int").alias("variant"),
        gold.alias("gold_json"),
        completion.alias("completion"),
    )


def reasoning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning-trace rows from ``documents``: problem = first line, solution
    = text inside think tags (some without), expected answer by residue: a
    number, a word, '1d'-style, space-padded number or empty."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars", "lang"], key="doc_id")
    i = F.col("doc_id")
    expected = (F.when(i % 5 == 0, _s(F.col("n_chars")))
                .when(i % 5 == 1, F.lit("forty"))
                .when(i % 5 == 2, F.concat(_s(i % 10), F.lit("d")))
                .when(i % 5 == 3, F.concat(F.lit(" "), _s(i % 10), F.lit(" ")))
                .otherwise(F.lit("")))
    text = F.col("text")
    gen = (F.when(i % 7 == 3, text)
           .when(i % 5 == 0, F.concat(F.lit("  " + K.THINK_OPEN), text, F.lit(K.THINK_CLOSE + "\n\n")))
           .otherwise(F.concat(F.lit(K.THINK_OPEN + "\n"), text, F.lit("\n" + K.THINK_CLOSE + "\nThe answer is "), expected)))
    problem = F.substring_index(text, "\n", 1)
    solution = F.when(i % 3 == 0, F.concat(problem, F.lit("\n" + K.HASH_MARK + " "), expected)).otherwise(problem)
    return d.select(i.alias("doc_id"), problem.alias("problem"), gen.alias("generated_solution"),
                    expected.alias("expected_answer"), solution.alias("solution"), "lang")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])


def patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw patent records from ``orders`` (+ ``documents`` text as the
    description where the keys meet): typed columns, absent keys as null,
    ``claims`` a list or a string, and ``raw_json`` the record as JSON with
    absent keys left out."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
                   key="o_orderkey")
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    r = o.join(d, o.o_orderkey == d.doc_id, "left")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    filing = F.to_date("o_orderdate")
    ymd = lambda x: F.date_format(x, "yyyy-MM-dd")
    title = (F.when(k % 5 == 0, F.concat(F.lit("Order "), _s(k), F.lit(' for "customer" '), _s(cust), F.lit(" & co")))
             .when(k % 17 == 4, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Order "), _s(k), F.lit(" for customer "), _s(cust))))
    rec = r.select(
        k.alias("record_id"),
        F.concat(F.lit("record_"), F.lpad(_s(k), 10, "0"), F.lit(".json")).alias("file_name"),
        F.when(k % 13 != 0, F.concat(F.lit("US"), _s(k), F.lit("A1"))).alias("publication_number"),
        F.concat(_s(cust), F.lit("/"), _s(k)).alias("application_number"),
        _s(k * 7).alias("patent_number"),
        ymd(F.date_add(filing, 30)).alias("date_published"),
        ymd(filing).alias("filing_date"),
        ymd(F.date_add(filing, 400)).alias("patent_issue_date"),
        F.when(k % 4 != 0, F.lit("")).alias("abandon_date"),
        F.when(F.col("o_orderstatus") == "F", "ACCEPTED").when(F.col("o_orderstatus") == "O", "PENDING")
        .otherwise("REJECTED").alias("decision"),
        F.col("o_orderpriority").alias("main_cpc_label"),
        F.concat(F.lit("G06F"), _s(k % 100)).alias("main_ipcr_label"),
        title.alias("title"),
        F.when(k % 11 != 3, F.concat(F.lit("Total price "), _s(F.floor("o_totalprice")), F.lit(" <USD>"))).alias("abstract"),
        F.when(k % 3 != 0, F.concat(F.lit("Summary of order "), _s(k))).alias("summary"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("Claim about part "), _s(k % 50)),
                                   F.concat(F.lit("Second claim for 'c"), _s(cust), F.lit("' &copy; &nbsp;&#x27;")))).alias("claims_list"),
        F.when(k % 2 == 1, F.concat(F.lit("Single claim text for "), _s(k))).alias("claims_text"),
        F.when(k % 5 != 1, F.col("text")).alias("description"),
        F.when(k % 5 == 1, F.split("text", "\n", -1)).alias("description_list"),
        F.when(k % 6 == 3, F.concat(F.lit("Cleo "), _s(cust))).alias("inventors_text"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("Ann "), _s(cust)), F.concat(F.lit("Bob "), _s(k)))).alias("inventors"),
        F.when(k % 3 == 1, F.concat(F.lit("Applicant "), _s(cust))).alias("applicant"),
        F.when(k % 5 == 2, ymd(F.date_add(filing, 60))).alias("publication_date"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("figs/fig_"), _s(k), F.lit("_1.png")),
                                   F.concat(F.lit("figs/sub/fig_"), _s(k), F.lit("_2.png")))).alias("figures"),
    )
    raw = F.to_json(F.struct(*[F.col(cname) for cname in rec.columns if cname not in ("record_id", "file_name", "claims_list", "claims_text", "description_list", "inventors_text")],
                             F.coalesce(F.col("claims_list"), F.array(F.col("claims_text"))).alias("claims")))
    return rec.withColumn("raw_json", raw)


def guess_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guess-game completions from ``orders``: 0, 1 or 2 guess tags, upper and
    lower case, non-letter guesses, by residue."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"], key="o_orderkey")
    k = F.col("o_orderkey")
    words = F.array(*[F.lit(w) for w in K.GUESS_WORDS])
    ans = F.element_at(words, (k % 20 + 1).cast("int"))
    other = F.element_at(words, ((k + 7) % 20 + 1).cast("int"))
    v = k % 6
    text = (F.when(v == 0, F.concat(F.lit("<guess>"), ans, F.lit("</guess>")))
            .when(v == 1, F.concat(F.lit("<guess> "), F.upper(ans), F.lit(" </guess>")))
            .when(v == 2, F.concat(F.lit("I think <guess>"), other, F.lit("</guess> no, <guess>"), ans, F.lit("</guess>")))
            .when(v == 3, F.concat(F.lit("no tags "), ans))
            .when(v == 4, F.concat(F.lit("<guess>"), other, F.lit("</guess>")))
            .otherwise(F.lit("<guess>abc123</guess>")))
    return o.select(k.alias("row_id"), ans.alias("answer"), text.alias("completion"))


def trajectory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows of stored rollouts: one trajectory per conversation,
    tool calls on assistant turns by residue, a judge response per
    trajectory (valid, rejecting or broken JSON; acceptance from
    ``labels.quality`` where present)."""
    cv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"], key="conv_id")
    k, t = F.col("conv_id"), F.col("turn")
    r = (k + t) % 3
    is_asst = F.col("role") == "assistant"
    name = F.when(is_asst & (r == 0), F.lit("search_inbox")).when(is_asst & (r == 1), F.lit(K.FINAL_ANSWER_TOOL))
    args = (F.when(name == "search_inbox",
                   F.concat(F.lit('{"keywords": ["w'), _s(k % 9), F.lit('", "t'), _s(t), F.lit('"]}')))
            .when(name == K.FINAL_ANSWER_TOOL,
                  F.concat(F.lit('{"answer": "answer '), _s(k), F.lit("-"), _s(t),
                           F.lit('", "reference_message_ids": ["m'), _s(k % 7), F.lit('", "m'), _s((k + t) % 5), F.when(k % 17 == 5, F.lit('"]} extra')).otherwise(F.lit('"]}')))))
    return cv.select(
        k.alias("traj_id"), t.alias("turn"), "role",
        F.col("text").alias("content"),
        name.alias("name"),
        F.when(name.isNotNull(), F.concat(F.lit("call_"), _s(k), F.lit("_"), _s(t))).alias("tool_call_id"),
        args.alias("tool_args"),
    )


def trajectory_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per trajectory: group (4 rollouts of one scenario), step, split,
    reward, expected source ids and the stored judge response."""
    cv = read_table(spark, sf_dir, "conversations", ["conv_id"]).distinct()
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    j = cv.join(lab, cv.conv_id == lab.doc_id, "left")
    k = F.col("conv_id")
    accept = F.when(F.col("quality") == 1, F.lit("true")).otherwise(F.lit("false"))
    resp = (F.when(k % 5 == 0, F.concat(F.lit('{"reasoning": "cut off at '), _s(k)))
            .when(k % 35 == 1, F.lit("{'reasoning': 'single quotes', 'accept': true}"))
            .when(k % 35 == 2, F.lit('{"reasoning": "then more", "accept": true} trailing'))
            .when(k % 35 == 3, F.lit('{"reasoning": "flag as text", "accept": "true"}'))
            .when(k % 35 == 4, F.lit('{"reasoning": "flag as number", "accept": 1}'))
            .when(k % 35 == 6, F.lit('{"reasoning": 7, "accept": true}'))
            .when(k % 35 == 7, F.lit('{"reasoning": "no such flag", "accept": 2}'))
            .when(k % 35 == 8, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit('{"reasoning": "checked '), _s(k), F.lit('", "accept": '), accept, F.lit("}"))))
    return j.select(
        k.alias("traj_id"),
        F.floor(k / 4).alias("group_id"),
        F.floor(k / 8).alias("step"),
        F.when(k % 10 < 8, F.lit("train")).otherwise(F.lit("val")).alias("split"),
        ((k * 37) % 100 / 100.0).alias("reward"),
        F.array(F.concat(F.lit("m"), _s(k % 7)), F.concat(F.lit("m"), _s(k % 3))).alias("expected_ids"),
        resp.alias("judge_response"),
    )


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named arrays from ``embeddings``: entries with |x| < 0.05 set to 0,
    all zero when ``vec_id % 50 = 0``."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"], key="vec_id")
    arr = F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: F.lit(0.0)))
    arr = arr.otherwise(F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 0.05, F.lit(0.0))
                                    .otherwise(x.cast("double"))))
    return e.select("vec_id", arr.alias("values"))
