"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query runs a library operator over a whole driver table (or a fixture
derived from it). Computed doubles that depend on summation order are rounded
to 6 decimals so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import batch, groups, math_rewards
from ..session import scratch_path
from ..sources import readers
from ..sources.tables import read_table
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _scored_math(spark, sf_dir):
    return math_rewards.score_math(fx.math_rows(spark, sf_dir))


@register("math_rewards")
def q_math_rewards(spark, sf_dir):
    return _scored_math(spark, sf_dir).select(
        "prompt_id", "gen_idx", "format_exact", "format_approx", "answer_reward", "number_reward", "reward")


@register("group_normalize")
def q_group_normalize(spark, sf_dir):
    df = groups.group_normalize(_scored_math(spark, sf_dir))
    return df.select("prompt_id", "gen_idx", "reward", F.round("advantage", 6).alias("advantage"))


@register("group_rank")
def q_group_rank(spark, sf_dir):
    return groups.group_rank(_scored_math(spark, sf_dir)).select("prompt_id", "gen_idx", "reward", "rank")


def _odd_groups(spark, sf_dir):
    """Rewards with one group that holds a third of the rows, null keys, null
    rewards and equal tiebreaks."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    k = F.col("l_orderkey")
    return li.select(
        k.alias("order_key"), F.col("l_linenumber").alias("line"),
        F.when(k % 3 == 0, F.lit(0)).when(k % 11 != 1, F.floor(k / 40)).cast("long").alias("grp"),
        F.when(k % 13 != 2, F.col("l_quantity").cast("double")).alias("reward"), F.floor(F.col("l_linenumber") / 2).cast("long").alias("tie"))


@register("group_rank_odd")
def q_group_rank_odd(spark, sf_dir):
    r = groups.group_rank(_odd_groups(spark, sf_dir), "grp", "reward", "tie")
    return r.select("grp", "reward", "tie", "rank")  # equal rows differ in nothing but their ranks


@register("group_normalize_odd")
def q_group_normalize_odd(spark, sf_dir):
    r = groups.group_normalize(_odd_groups(spark, sf_dir), "grp")
    return r.select("order_key", "line", "grp", F.round("advantage", 6).alias("advantage"))


@register("group_stats")
def q_group_stats(spark, sf_dir):
    s = groups.group_stats(_scored_math(spark, sf_dir))
    return s.select("prompt_id", F.round("mean_reward", 6).alias("mean_reward"),
                    F.round("std_reward", 6).alias("std_reward"), "n")


@register("batch_scorer")
def q_batch_scorer(spark, sf_dir):
    """The completions of a prompt as strings, as messages and as lists of
    messages, all against the prompt's own answer."""
    rows = fx.math_rows(spark, sf_dir)
    gold = rows.groupBy("prompt_id").agg(F.min_by("answer", "gen_idx").alias("answer"))

    def message(text):
        return F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    text = F.col("completion")
    forms = {0: text, 1: message(text), 2: F.array(message(F.lit("Working.")), message(text))}
    parts = []
    for k, form in forms.items():
        own = rows.filter(F.col("prompt_id") % 3 == k).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("gen_idx", form.alias("c")))).alias("x"))
        parts.append(batch.score_batch(own.select("prompt_id", F.col("x.c").alias("completions")), gold, math_rewards.score_math))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("prompt_id", F.col("gen_idx").cast("int").alias("gen_idx"), "format_exact", "answer_reward", "number_reward", "reward")


@register("batch_unscored")
def q_batch_unscored(spark, sf_dir):
    """Prompts and gold rows that the batch scorer gives no rows for."""
    rows = fx.math_rows(spark, sf_dir)
    k = F.col("prompt_id")
    prompts = rows.filter(k % 7 != 3).groupBy("prompt_id").agg(F.collect_list(F.when(k % 5 != 2, F.col("completion"))).alias("completions"))
    gold = rows.filter(k % 11 != 6).groupBy("prompt_id").agg(F.min_by("answer", "gen_idx").alias("answer"))
    return batch.unscored(prompts, gold)


@register("math_reward_total")
def q_math_reward_total(spark, sf_dir):
    return _scored_math(spark, sf_dir).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("reward"), 6).alias("mean_reward"),
        F.round(F.stddev_pop("reward"), 6).alias("std_reward"),
        F.min("reward").alias("min_reward"),
        F.max("reward").alias("max_reward"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised, ranked rewards per prompt group: math rewards -> total ->
    group-relative advantage -> rank, over one range partitioning."""
    df = groups.normalize_and_rank(_scored_math(spark, sf_dir).drop("completion", "answer", "event_time", "variant"))
    return df.select("prompt_id", "gen_idx", "format_exact", "format_approx", "answer_reward",
                     "number_reward", "reward", F.round("advantage", 6).alias("advantage"), "rank")


register("flagship_advantages")(flagship)


# ----------------------------------------------------------------- corpus
from ..operators import corpus, search  # noqa: E402


def _kept(spark, sf_dir):
    return corpus.dedup_emails(fx.email_source(spark, sf_dir))


@register("email_filters")
def q_email_filters(spark, sf_dir):
    """Rows that pass the cleaning, body-length and recipient-count steps."""
    staged = corpus.with_outcome(corpus.clean_addresses(fx.email_source(spark, sf_dir)))
    return staged.filter(F.col("stage_outcome") == "candidate").select(
        "message_id", corpus.recipient_count().alias("n_recipients"), F.length("body").alias("body_chars"))


@register("email_dedup")
def q_email_dedup(spark, sf_dir):
    return _kept(spark, sf_dir).select("message_id", "ordinal", "dropped_copies")


@register("email_outcomes")
def q_email_outcomes(spark, sf_dir):
    return corpus.build_outcomes(fx.email_source(spark, sf_dir))


@register("email_build")
def q_email_build(spark, sf_dir):
    return corpus.emails_table(_kept(spark, sf_dir))


@register("recipients_build")
def q_recipients_build(spark, sf_dir):
    return corpus.recipients_table(_kept(spark, sf_dir)).select(
        "email_id", "recipient_address", "recipient_type", F.col("position").cast("int").alias("position"))


@register("unique_check")
def q_unique_check(spark, sf_dir):
    emails = corpus.emails_table(_kept(spark, sf_dir)).withColumn("message_id", F.substring("message_id", 1, 3))
    return corpus.unique_violations(emails)


@register("corpus_counts")
def q_corpus_counts(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    e = corpus.emails_table(kept).agg(F.count(F.lit(1)).alias("n")).select(F.lit("emails").alias("table_name"), "n")
    r = corpus.recipients_table(kept).agg(F.count(F.lit(1)).alias("n")).select(F.lit("recipients").alias("table_name"), "n")
    return e.unionByName(r)


def _tables(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return corpus.emails_table(kept), corpus.recipients_table(kept)


def _lookup_ids(spark, sf_dir):
    return fx.scenarios(spark, sf_dir).select(F.explode("message_ids").alias("message_id"))


@register("read_email")
def q_read_email(spark, sf_dir):
    store = _store(spark, sf_dir)
    out = corpus.read_emails(store.emails, store.recipients_by_id, _lookup_ids(spark, sf_dir))
    return out.select("message_id", "date", "subject", "from_address",
                      *[F.array_join(f"{k}_addresses", ",").alias(f"{k}_addresses") for k in ("to", "cc", "bcc")],
                      F.length("body").alias("body_chars"), "file_name")


@register("index_postings")
def q_index_postings(spark, sf_dir):
    emails, _ = _tables(spark, sf_dir)
    return search.postings(emails).select("term", "message_id", "field", F.col("pos").cast("int").alias("pos"))


def search_requests(spark, sf_dir):
    s = fx.scenarios(spark, sf_dir)
    i = F.col("id")
    return s.select(
        i.alias("request_id"),
        F.col("inbox_address").alias("inbox"),
        "keywords",
        F.when(i % 5 == 0, F.lit("en@ex.com")).when(i % 5 == 1, F.lit("")).alias("from_addr"),
        F.when(i % 6 == 1, F.lit("u3@ex.com")).when(i % 6 == 2, F.lit("")).alias("to_addr"),
        F.when(i % 3 == 0, F.lit("2001-01-10")).when(i % 3 == 1, F.lit("")).alias("sent_after"),
        F.when(i % 7 == 3, F.lit("")).when(i % 7 != 4, F.col("query_date")).alias("sent_before"),
        F.when(i % 9 != 5, (i % 10 + 1).cast("int")).alias("max_results"),
    )


def _store(spark, sf_dir):
    from .store import corpus_store
    return corpus_store(spark, sf_dir)


@register("corpus_search")
def q_corpus_search(spark, sf_dir):
    """Batch search over the stored corpus and postings (built once)."""
    store = _store(spark, sf_dir)
    res = search.search(store.mail, store.recipients, search_requests(spark, sf_dir), store.lists, store.stats)
    return res.select("request_id", F.col("rank").cast("int").alias("rank"), "message_id", "date")


@register("scenario_search")
def q_scenario_search(spark, sf_dir):
    store = _store(spark, sf_dir)
    res = search.search(store.mail, store.recipients, search.scenario_requests(fx.scenarios(spark, sf_dir)), store.lists, store.stats)
    return res.select("request_id", F.col("rank").cast("int").alias("rank"), "message_id", "date")


@register("search_snippets")
def q_search_snippets(spark, sf_dir):
    store = _store(spark, sf_dir)
    req = search.scenario_requests(fx.scenarios(spark, sf_dir))
    res = search.search(store.mail, store.recipients, req, store.lists, store.stats)
    return search.snippets(res, req, store.emails).select(
        "request_id", F.col("rank").cast("int").alias("rank"), "message_id", "field", "snippet")


@register("inbox_semi_join")
def q_inbox_semi_join(spark, sf_dir):
    """Messages visible in each scenario's inbox (sender or recipient)."""
    emails, rec = _tables(spark, sf_dir)
    inboxes = fx.scenarios(spark, sf_dir).select(F.col("id").alias("request_id"), F.col("inbox_address").alias("inbox"))
    p = search.parties(emails, rec, inboxes.select(F.col("inbox").alias("address")))
    j = inboxes.join(p, inboxes.inbox == p.party)
    return j.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_messages"))


@register("search_filters")
def q_search_filters(spark, sf_dir):
    """Inbox mail of each request that passes its filters, without keywords."""
    emails, rec = _tables(spark, sf_dir)
    found = search.inbox_messages(emails, rec, search_requests(spark, sf_dir))
    return found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_messages"))


@register("rejected_requests")
def q_rejected_requests(spark, sf_dir):
    """Requests that the search does not answer, with the reason."""
    i = F.col("request_id")
    req = search_requests(spark, sf_dir).withColumns({
        "keywords": F.when(i % 8 == 1, F.array().cast("array<string>")).when(i % 8 == 2, F.array(F.lit("?!"))).when(i % 8 != 3, F.col("keywords")),
        "max_results": F.when(i % 8 == 4, F.lit(11)).otherwise(F.col("max_results"))})
    return search.rejections(req)


# ------------------------------------------------------- extraction rewards
from ..operators import extraction  # noqa: E402


def _ie_scored(spark, sf_dir):
    rows = fx.ie_rows(spark, sf_dir)
    return extraction.score_extraction(extraction.parse_gold(rows))


def _r6(name):
    return F.round(name, 6).alias(name)


@register("ie_rewards")
def q_ie_rewards(spark, sf_dir):
    s = _ie_scored(spark, sf_dir)
    return s.select("row_id", "validity", _r6("field_mean"), "constraints", "format", _r6("reward"))


@register("ie_validity")
def q_ie_validity(spark, sf_dir):
    return _ie_scored(spark, sf_dir).select("row_id", "validity")


@register("ie_field_scores")
def q_ie_field_scores(spark, sf_dir):
    return extraction.field_scores_long(_ie_scored(spark, sf_dir), ["row_id"]).select("row_id", "field", _r6("sim"))


@register("ie_field_mean")
def q_ie_field_mean(spark, sf_dir):
    return _ie_scored(spark, sf_dir).select("row_id", _r6("field_mean"))


@register("ie_constraints")
def q_ie_constraints(spark, sf_dir):
    return _ie_scored(spark, sf_dir).select("row_id", "constraints")


@register("ie_format")
def q_ie_format(spark, sf_dir):
    return _ie_scored(spark, sf_dir).select("row_id", "format")


@register("parse_outcomes")
def q_parse_outcomes(spark, sf_dir):
    s = extraction.parse_pred(fx.ie_rows(spark, sf_dir))
    return s.select("row_id", F.col("pred.outcome").alias("outcome"), F.size("pred.keys").alias("n_keys")).select(
        "row_id", "outcome", F.when(F.col("n_keys") >= 0, F.col("n_keys")).alias("n_keys"))


@register("parse_outcome_counts")
def q_parse_outcome_counts(spark, sf_dir):
    """How the completions of each prompt parsed."""
    s = extraction.parse_pred(fx.ie_rows(spark, sf_dir))
    return s.groupBy("prompt_id", F.col("pred.outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("date_profile")
def q_date_profile(spark, sf_dir):
    return extraction.date_format_profile(extraction.parse_pred(fx.ie_rows(spark, sf_dir)))


@register("reward_join")
def q_reward_join(spark, sf_dir):
    """Completions joined to their gold by key, scored, then normalised per
    prompt group (gold parsed once per key before the join)."""
    rows = fx.ie_rows(spark, sf_dir)
    gold = extraction.parse_gold(rows.select("row_id", "gold_json")).drop("gold_json")
    comps = rows.select("row_id", "prompt_id", "completion")
    scored = extraction.score_extraction(comps.join(gold, "row_id"))
    out = groups.group_normalize(scored, "prompt_id")
    return out.select("row_id", "prompt_id", _r6("reward"), _r6("advantage"))


@register("normalize_text")
def q_normalize_text(spark, sf_dir):
    from ..sources.tables import read_table
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", extraction.norm_value(F.col("text")).alias("norm"))


@register("pair_similarity")
def q_pair_similarity(spark, sf_dir):
    """Distinct (gold, prediction) normalised pairs of used fields, and of each
    gold text with a beginning of it, with their similarity."""
    rows = fx.ie_rows(spark, sf_dir)
    parsed = extraction.parse_pred(extraction.parse_gold(rows.select("row_id", "gold_json", "completion")))
    pairs = extraction.field_pairs(parsed)
    begun = F.substring("gold_norm", 1, F.length("gold_norm") % 7 + 2)
    own, cut = F.struct("gold_norm", "pred_norm"), F.struct("gold_norm", begun.alias("pred_norm"))
    both = F.when(F.col("gold_norm") == F.col("pred_norm"), F.array(own, cut)).otherwise(F.array(own))
    out = extraction.pair_similarities(pairs.select(F.inline(both)))
    return out.select("gold_norm", "pred_norm", _r6("sim"))


# ------------------------------------------------------- prompts and chat
from ..operators import prompts, sampling  # noqa: E402

MAX_SEQ_LENGTH = 2048


@register("extraction_prompt")
def q_extraction_prompt(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", prompts.extraction_prompt("text").alias("prompt"))


def manifest(spark, sf_dir):
    """Manifest stand-in: document text with the gold record of the same key."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    g = fx.ie_rows(spark, sf_dir).select(F.col("row_id").alias("doc_id"), "gold_json")
    return d.join(g, "doc_id").select(
        F.concat(F.lit("patent_"), F.col("doc_id").cast("string")).alias("patent_id"), "doc_id", "text", "gold_json")


@register("sft_samples")
def q_sft_samples(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return m.select("patent_id", prompts.sft_sample(prompts.extraction_prompt("text"), F.col("gold_json")).alias("text"))


@register("training_rows")
def q_training_rows(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return m.select(prompts.extraction_prompt("text").alias("prompt"), "gold_json", "patent_id")


@register("reasoning_messages")
def q_reasoning_messages(spark, sf_dir):
    r = fx.reasoning_rows(spark, sf_dir)
    r = r.filter(prompts.numeric_answer("expected_answer"))
    m = r.select("doc_id", prompts.reasoning_messages("problem", "generated_solution", "expected_answer").alias("m"))
    return m.select("doc_id", F.size("m").alias("n_messages"), F.col("m")[0]["content"].alias("system_content"),
                    F.col("m")[1]["content"].alias("user_content"), F.col("m")[2]["content"].alias("assistant_content"))


@register("numeric_filter")
def q_numeric_filter(spark, sf_dir):
    r = fx.reasoning_rows(spark, sf_dir)
    return r.filter(prompts.numeric_answer("expected_answer")).select("doc_id", "expected_answer")


def _chat_texts(spark, sf_dir, add_generation_prompt=True):
    conv = prompts.conversations_to_messages(fx.chat(spark, sf_dir))
    return conv.select("conv_id", prompts.render_chat("messages", add_generation_prompt=add_generation_prompt).alias("text"))


@register("chat_template")
def q_chat_template(spark, sf_dir):
    return _chat_texts(spark, sf_dir)


@register("token_budget_filter")
def q_token_budget_filter(spark, sf_dir):
    t = _chat_texts(spark, sf_dir, add_generation_prompt=False)
    t = t.select("conv_id", prompts.ws_token_count("text").alias("n_tokens"))
    return prompts.token_budget_filter(t, "n_tokens", MAX_SEQ_LENGTH)


@register("quantile_length_filter")
def q_quantile_length_filter(spark, sf_dir):
    t = _chat_texts(spark, sf_dir, add_generation_prompt=False)
    t = t.select("conv_id", prompts.ws_token_count("text").alias("n_tokens"))
    return prompts.quantile_length_filter(t, "n_tokens", 0.9)


@register("flatten_messages")
def q_flatten_messages(spark, sf_dir):
    conv = prompts.conversations_to_messages(fx.chat(spark, sf_dir))
    return conv.select("conv_id", prompts.flatten_messages("messages").alias("text"))


@register("split_reasoning")
def q_split_reasoning(spark, sf_dir):
    r = fx.reasoning_rows(spark, sf_dir)
    thinking, content = prompts.split_reasoning("generated_solution")
    return r.select("doc_id", thinking.alias("thinking"), content.alias("content"))


@register("hash_answer")
def q_hash_answer(spark, sf_dir):
    r = fx.reasoning_rows(spark, sf_dir)
    return r.select("doc_id", prompts.hash_answer("solution").alias("answer"),
                    prompts.hash_answer("solution", marked=True).alias("marked_answer"))


@register("prompt_messages")
def q_prompt_messages(spark, sf_dir):
    r = fx.reasoning_rows(spark, sf_dir)
    m = r.select("doc_id", prompts.prompt_messages("problem").alias("prompt"), prompts.hash_answer("solution").alias("answer"))
    return m.select("doc_id", F.size("prompt").alias("n_messages"), F.col("prompt")[0]["role"].alias("first_role"),
                    F.col("prompt")[1]["content"].alias("user_content"), "answer")


@register("transcript_preview")
def q_transcript_preview(spark, sf_dir):
    c = fx.chat(spark, sf_dir)
    return c.select("conv_id", "turn", "role", prompts.preview("role", "text").alias("preview"))


@register("agent_prompt")
def q_agent_prompt(spark, sf_dir):
    s = fx.scenarios(spark, sf_dir)
    return s.select("id", prompts.agent_system_prompt("inbox_address", "query_date").alias("system_content"),
                    F.col("question").alias("user_content"))


@register("pack_sequences")
def q_pack_sequences(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    t = d.select("doc_id", prompts.ws_token_count("text").alias("n_tokens"))
    return sampling.pack_blocks(t, ["doc_id"], "n_tokens", MAX_SEQ_LENGTH).select(
        "doc_id", "n_tokens", "start", "first_block", "last_block")


@register("packed_blocks")
def q_packed_blocks(spark, sf_dir):
    """The blocks themselves: which tokens of which documents each holds."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    t = d.select("doc_id", prompts.ws_token_count("text").alias("n_tokens"))
    cut = sampling.block_pieces(sampling.pack_blocks(t, ["doc_id"], "n_tokens", MAX_SEQ_LENGTH), "doc_id", "n_tokens", MAX_SEQ_LENGTH)
    return cut.groupBy("block").agg(
        F.sum("n").alias("n_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id", "offset", "n"))),
                                 lambda x: F.concat_ws(":", x["doc_id"], x["offset"], x["n"])), ",").alias("pieces"))


# ------------------------------------------------------------ patent records
from ..operators import records  # noqa: E402
from .. import constants as K  # noqa: E402


@register("relevant_fields")
def q_relevant_fields(spark, sf_dir):
    p = fx.patents(spark, sf_dir).select("record_id", records.project_json("raw_json").alias("r"))
    return p.select("record_id", *[F.col("r")[f].alias(f) for f in K.PROJECTED_FIELDS])


@register("sanitize_text")
def q_sanitize_text(spark, sf_dir):
    pg = read_table(spark, sf_dir, "pages", ["page_id", "html"], key="page_id")
    return pg.select("page_id", records.sanitize("html").alias("text"))


@register("render_document")
def q_render_document(spark, sf_dir):
    p = fx.patents(spark, sf_dir)
    return p.select("record_id", records.render_document(p).alias("text"))


def _split_records(spark, sf_dir):
    p = fx.patents(spark, sf_dir).select("record_id", "file_name", "publication_number")
    return sampling.positional_split(p, ["file_name"])


@register("positional_split")
def q_positional_split(spark, sf_dir):
    s = _split_records(spark, sf_dir)
    return s.select("record_id", "split", "position",
                    records.file_stem("publication_number", "position").alias("stem"))


def _listings(spark, sf_dir):
    s = _split_records(spark, sf_dir).withColumn("stem", records.file_stem("publication_number", "position"))
    k = F.col("record_id")
    folder = F.when(F.col("split") == "train", F.lit("Train_data")).otherwise(F.lit("Val_data"))
    pdfs = s.filter(k % 7 != 1).select("stem", F.concat(folder, F.lit("/pdfs/"), F.col("stem"), F.lit(".pdf")).alias("path"))
    labels = s.filter(k % 11 != 2).select("stem", F.concat(folder, F.lit("/labels/"), F.col("stem"), F.lit(".json")).alias("path"))
    return s, pdfs, labels


@register("pair_by_stem")
def q_pair_by_stem(spark, sf_dir):
    _, pdfs, labels = _listings(spark, sf_dir)
    return records.pair_by_stem(pdfs, labels)


@register("label_records")
def q_label_records(spark, sf_dir):
    s = _split_records(spark, sf_dir).select("record_id", "position")
    p = fx.patents(spark, sf_dir).join(s, "record_id")
    return p.select(records.file_stem("publication_number", "position").alias("file_stem"),
                    records.label_json().alias("json"))


@register("gold_lookup")
def q_gold_lookup(spark, sf_dir):
    s, pdfs, labels = _listings(spark, sf_dir)
    manifest = records.pair_by_stem(pdfs, labels)
    p = fx.patents(spark, sf_dir).join(s.select("record_id", "stem", "position"), "record_id")
    contents = p.join(labels, "stem").select("path", records.label_json().alias("content"))
    rows, _missing = records.attach_labels(manifest, contents)
    return rows.select("patent_id", "gold_json")


@register("gold_missing")
def q_gold_missing(spark, sf_dir):
    """Manifest rows whose label file has no content (those whose stem's digest begins with 0 or 1 are absent)."""
    _, pdfs, labels = _listings(spark, sf_dir)
    manifest = records.pair_by_stem(pdfs, labels)
    contents = labels.filter(~F.substring(F.md5("stem"), 1, 1).isin("0", "1")).select("path", F.lit("{}").alias("content"))
    _, missing = records.attach_labels(manifest, contents)
    return missing.select("patent_id", F.lit("label file missing").alias("reason"))


# ---------------------------------------- guess / judge / trajectories
from ..operators import trajectories as trj  # noqa: E402


@register("guess_reward")
def q_guess_reward(spark, sf_dir):
    g = fx.guess_rows(spark, sf_dir)
    return g.select("row_id", trj.guess_reward("completion", "answer").alias("reward"))


@register("synthetic_tasks")
def q_synthetic_tasks(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    return sampling.synthetic_tasks(o, "o_orderkey")


def _trajectories(spark, sf_dir):
    return trj.build_trajectories(fx.trajectory_rows(spark, sf_dir))


@register("trajectory_messages")
def q_trajectory_messages(spark, sf_dir):
    f = trj.flatten(_trajectories(spark, sf_dir))
    return f.select("traj_id", F.col("pos").cast("int").alias("pos"), "role", "tool_name", "tool_call_id")


@register("tool_calls")
def q_tool_calls(spark, sf_dir):
    c = trj.tool_calls(trj.flatten(_trajectories(spark, sf_dir)))
    return c.select("traj_id", F.col("pos").cast("int").alias("pos"), "tool_name",
                    F.array_join("keywords", ",").alias("keywords"), "answer",
                    F.array_join("source_ids", ",").alias("source_ids"))


def _finals(spark, sf_dir):
    return trj.final_answers(trj.tool_calls(trj.flatten(_trajectories(spark, sf_dir))))


@register("final_answers")
def q_final_answers(spark, sf_dir):
    return _finals(spark, sf_dir).select("traj_id", F.col("pos").cast("int").alias("pos"), "answer",
                                         F.array_join("source_ids", ",").alias("source_ids"))


@register("turn_cap")
def q_turn_cap(spark, sf_dir):
    t = trj.cap_turns(_trajectories(spark, sf_dir), K.MAX_TURNS)
    return t.select("traj_id", F.size("messages").alias("n_messages"))


@register("source_coverage")
def q_source_coverage(spark, sf_dir):
    meta = fx.trajectory_meta(spark, sf_dir).select("traj_id", "expected_ids")
    s = trj.source_coverage(_finals(spark, sf_dir), meta)
    return s.select("traj_id", "n_used", "n_expected", "n_hit", _r6("precision"), _r6("recall"))


@register("group_prefix")
def q_group_prefix(spark, sf_dir):
    t = _trajectories(spark, sf_dir).withColumn("group_id", F.floor(F.col("traj_id") / 4))
    return trj.group_prefix(t, "group_id")


@register("without_prefix")
def q_without_prefix(spark, sf_dir):
    """Messages that each trajectory has beyond its group's shared prefix."""
    t = _trajectories(spark, sf_dir).withColumn("group_id", F.floor(F.col("traj_id") / 4))
    return trj.without_prefix(t, "group_id").select("traj_id", "prefix_len", F.size("messages").alias("n_left"))


@register("judge_verdicts")
def q_judge_verdicts(spark, sf_dir):
    v = trj.judge_verdicts(fx.trajectory_meta(spark, sf_dir))
    return v.select("traj_id", "parse_ok", "accept", "correct")


@register("validation_metrics")
def q_validation_metrics(spark, sf_dir):
    v = trj.judge_verdicts(fx.trajectory_meta(spark, sf_dir))
    return v.groupBy("split", "step").agg(F.round(F.avg("correct"), 6).alias("mean_correct"),
                                          F.count(F.lit(1)).alias("n"))


@register("trajectory_rank")
def q_trajectory_rank(spark, sf_dir):
    m = fx.trajectory_meta(spark, sf_dir)
    r = groups.group_rank(m, "group_id", "reward", "traj_id")
    return r.select("traj_id", "group_id", "reward", "rank")


@register("ranking_preview")
def q_ranking_preview(spark, sf_dir):
    """Each trajectory's rank in its group with the beginning of its last message."""
    ranked = groups.group_rank(fx.trajectory_meta(spark, sf_dir), "group_id", "reward", "traj_id")
    return trj.ranking_lines(fx.trajectory_rows(spark, sf_dir), ranked)


@register("judge_prompt")
def q_judge_prompt(spark, sf_dir):
    """System and user message for each answered trajectory: the question and
    reference answer of its scenario, and the answer that was given."""
    fa = _finals(spark, sf_dir).select("traj_id", "answer")
    own = fx.trajectory_meta(spark, sf_dir).select("traj_id", F.col("group_id").alias("id"))
    scen = fx.scenarios(spark, sf_dir).select("id", "question", F.col("answer").alias("reference"))
    j = fa.join(own, "traj_id").join(scen, "id")
    return j.select("traj_id", F.lit(K.JUDGE_SYSTEM_PROMPT).alias("system_content"),
                    prompts.judge_user_text("question", "reference", F.coalesce("answer", F.lit(""))).alias("user_content"))


@register("validation_plan")
def q_validation_plan(spark, sf_dir):
    val = fx.scenarios(spark, sf_dir).filter(F.col("split") == "test").select("id")
    return trj.validation_plan(val, 50, 5).select("id", F.col("step").cast("int").alias("step"))


@register("failure_budget")
def q_failure_budget(spark, sf_dir):
    m = trj.judge_verdicts(fx.trajectory_meta(spark, sf_dir)).withColumn("failed", ~F.col("parse_ok"))
    return trj.failure_budget(m, "step", "failed", 4).select("step", "n_failed", "n_items", "budget", "within_budget")


@register("fan_out")
def q_fan_out(spark, sf_dir):
    s = fx.scenarios(spark, sf_dir).select("id")
    return groups.fan_out(s, 4).select("id", F.col("gen_idx").cast("int").alias("gen_idx"))


@register("zero_fraction")
def q_zero_fraction(spark, sf_dir):
    t = fx.tensors(spark, sf_dir)
    z = trj.zero_fraction(t, "values")
    return t.select("vec_id", F.round(z, 6).alias("zero_frac"), (z == 1.0).alias("all_zero"))


# ------------------------------------------------------- sampling and sources
@register("seeded_shuffle")
def q_seeded_shuffle(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    return sampling.seeded_shuffle(o, "o_orderkey", 42)


@register("hash_split")
def q_hash_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    return sampling.hash_split(o, "o_orderkey", 3407, 1)


@register("epoch_batches")
def q_epoch_batches(spark, sf_dir):
    train = fx.scenarios(spark, sf_dir).filter(F.col("split") == "train").select("id")
    e = sampling.epoch_batches(train, "id", groups_per_step=2, num_epochs=20, seed=42, initial_step=0, max_steps=50)
    return e.select("id", F.col("epoch").cast("int").alias("epoch"), "step", "epoch_step", "slot")


@register("mini_batches")
def q_mini_batches(spark, sf_dir):
    m = manifest(spark, sf_dir).select("patent_id")
    b = sampling.mini_batches(m, "patent_id", 2, 42)
    return b.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "patent_id"))), lambda s: s["patent_id"]), ",").alias("patent_ids"))


@register("head_limit")
def q_head_limit(spark, sf_dir):
    m = manifest(spark, sf_dir).select("patent_id")
    return sampling.head_limit(m, ["patent_id"], 128)


@register("scenario_select")
def q_scenario_select(spark, sf_dir):
    """Train scenarios with at most one referenced message, seeded order, first 50."""
    path = scratch_path(spark, "scenarios")
    fx.scenarios(spark, sf_dir).drop("keywords").write.partitionBy("split").parquet(path)
    return readers.load_scenarios(spark, path, "train", limit=50, max_messages=1, shuffle=True, seed=42).select("id", "question")


@register("scenario_validation")
def q_scenario_validation(spark, sf_dir):
    s = fx.scenarios(spark, sf_dir)
    i = F.col("id")
    raw = s.select("id", "question", "answer", "message_ids", "inbox_address", "query_date",
                   F.when(i % 9 == 4, F.lit("n/a")).otherwise(F.col("how_realistic").cast("string")).alias("how_realistic"),
                   F.when(i % 11 == 5, F.lit("dev")).otherwise(F.col("split")).alias("split"))
    from ..operators import validation
    v = validation.validate_scenarios(raw)
    return v.select("id", "valid", "reason")


@register("math_source")
def q_math_source(spark, sf_dir):
    """The set is stored by config and split; the reader takes one folder."""
    path = scratch_path(spark, "math-set")
    split = F.when(F.col("doc_id") % 2 == 0, "cot").otherwise("tir")
    fx.reasoning_rows(spark, sf_dir).withColumns({"split": split}).withColumnRenamed("lang", "config").write.partitionBy("config", "split").parquet(path)
    return readers.read_math_set(spark, path, "en", "cot", ["doc_id", "expected_answer", "problem", "generated_solution"])


@register("email_source")
def q_email_source(spark, sf_dir):
    path = scratch_path(spark, "email-source")
    fx.email_source(spark, sf_dir).write.parquet(path)
    e = readers.read_email_source(spark, path)
    return e.select("message_id", "subject", "from", F.size("to").alias("n_to"), F.size("cc").alias("n_cc"),
                    F.size("bcc").alias("n_bcc"), F.date_format("date", K.EMAIL_DATE_FORMAT).alias("date"))


# ------------------------------------------------------ files, sinks and hooks
from ..operators import registry  # noqa: E402
from ..sources import files, sinks  # noqa: E402

PAGE_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())])


def _page_files(spark, sf_dir):
    """One JSON file for each page; some end early, some hold an array."""
    k = F.col("page_id")
    text = F.to_json(F.struct("page_id", "url", "html"))
    text = F.when(k % 9 == 4, F.substring(text, F.lit(1), F.length(text) - 1)).when(k % 9 == 5, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    path = scratch_path(spark, "page-files")
    return sinks.write_row_files(read_table(spark, sf_dir, "pages").select(text.alias("value")), path)


@register("raw_scan")
def q_raw_scan(spark, sf_dir):
    return files.read_raw_records(spark, _page_files(spark, sf_dir), PAGE_SCHEMA, glob="part-*")[0].select("page_id", "url")


@register("raw_rejected")
def q_raw_rejected(spark, sf_dir):
    bad = files.read_raw_records(spark, _page_files(spark, sf_dir), PAGE_SCHEMA, glob="part-*")[1]
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("raw_scan_first")
def q_raw_scan_first(spark, sf_dir):
    """The first 20 files by name, read whole: records and rejected files."""
    good, bad = files.read_raw_records(spark, _page_files(spark, sf_dir), PAGE_SCHEMA, limit=20, glob="part-*")
    return good.select("path").unionByName(bad.select("path")).agg(F.count(F.lit(1)).alias("n_files"))


@register("label_contents")
def q_label_contents(spark, sf_dir):
    whole = files.read_label_contents(spark, _page_files(spark, sf_dir), glob="part-*")
    return whole.select(F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"))


@register("file_listing")
def q_file_listing(spark, sf_dir):
    """Names and lengths only; no file is opened."""
    lst = files.list_files(spark, _page_files(spark, sf_dir), "part-*")
    return lst.agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("stem").alias("n_stems"), F.sum("length").alias("n_bytes"))


@register("training_sink")
def q_training_sink(spark, sf_dir):
    path = scratch_path(spark, "training-rows")
    sinks.write_training_rows(q_training_rows(spark, sf_dir), path)
    return spark.read.schema("prompt string, gold_json string, patent_id string").parquet(path)


@register("build_once")
def q_build_once(spark, sf_dir):
    """Built by the first call, read by the second."""
    path = scratch_path(spark, "built-once")
    rows = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    sinks.build_once(spark, path, lambda: rows.withColumn("built", F.lit(1)))
    return sinks.build_once(spark, path, lambda: rows.withColumn("built", F.lit(2)))


@register("required_columns")
def q_required_columns(spark, sf_dir):
    return records.require_columns(manifest(spark, sf_dir), "patent_id", "text").select("patent_id", F.length("text").alias("n_chars"))


def _length_reward(prompts, completions, answer):
    return [float(len(c)) if a in c else -1.0 for c, a in zip(completions, answer)]


@register("reward_registry")
def q_reward_registry(spark, sf_dir):
    """A built-in reward, a user's Python reward and their weighted sum."""
    registry.register_reward("length_reward", registry.python_reward(_length_reward, ("prompt", "completion", "answer")), ("prompt", "completion", "answer"))
    rows = fx.math_rows(spark, sf_dir).withColumn("prompt", F.col("prompt_id").cast("string"))
    return registry.score(rows, ["format_approx", "length_reward"], {"length_reward": 0.5}).select(
        "prompt_id", "gen_idx", "format_approx", "length_reward", "reward")


@register("map_batches")
def q_map_batches(spark, sf_dir):
    def heads(pdf):
        return pdf.assign(head=pdf["text"].str.slice(0, 10), n=pdf["text"].str.len().astype("int64"))[["conv_id", "turn", "head", "n"]]
    return registry.map_batches(fx.chat(spark, sf_dir), heads, "conv_id long, turn long, head string, n long")


@register("extract_hook")
def q_extract_hook(spark, sf_dir):
    """A strict extractor with a fallback, over the bytes of the pages."""
    def strict():
        def run(b):
            return b[:40].decode("ascii")
        return run

    def fallback():
        def run(b):
            if len(b) % 5 == 0:
                raise ValueError("unreadable")
            return "fallback"
        return run
    pages = read_table(spark, sf_dir, "pages", ["page_id", "html"]).select(
        F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return files.extract_text(pages, strict, fallback)


@register("token_counter")
def q_token_counter(spark, sf_dir):
    count = registry.token_counter(lambda: str.split)
    return fx.chat(spark, sf_dir).select("conv_id", "turn", count("text").alias("n_tokens"))


# ------------------------------------------------------------------ streaming
from ..streaming import index as sindex  # noqa: E402
from ..streaming import scores as sscores  # noqa: E402


def _completions(spark, sf_dir):
    return fx.math_rows(spark, sf_dir).withColumn(
        "event_time", F.timestamp_add("SECOND", F.col("prompt_id") * 10, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")))


@register("stream_scores")
def q_stream_scores(spark, sf_dir):
    """Stored completions scored as they arrive, several files a batch."""
    arriving = _completions(spark, sf_dir)
    path = scratch_path(spark, "completion-stream")
    arriving.repartition(4, "prompt_id").write.parquet(path)
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 2).parquet(path)
    scored = sscores.score_stream(stream).select(
        "prompt_id", "gen_idx", "format_exact", "format_approx", "answer_reward", "number_reward", "reward")
    return sscores.run_available(scored, scratch_path(spark, "scores"), scratch_path(spark, "ckpt-scores"))


@register("stream_group_stats")
def q_stream_group_stats(spark, sf_dir):
    """Windowed group statistics in append mode.  A marker two days ahead
    closes the windows (its own stays open); rows that arrive for closed
    windows afterwards change nothing."""
    arriving = _completions(spark, sf_dir)
    path, out, ckpt = (scratch_path(spark, f"group-stats-{x}") for x in ("in", "out", "ckpt"))
    day = F.expr("event_time + INTERVAL 2 DAYS")
    marker = arriving.orderBy(F.col("event_time").desc(), "gen_idx").limit(1).withColumn("event_time", day)
    late = arriving.filter("gen_idx = 0").withColumn("completion", F.lit("late"))
    for rows in (arriving, marker, late):
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(arriving.schema).parquet(path)
        stats = sscores.run_available(sscores.group_stats_stream(sscores.score_stream(stream)), out, ckpt)
    return stats.select("prompt_id", sscores.instant_to_utc_text(F.col("window.start")).alias("window_start"),
                        F.round("mean_reward", 6).alias("mean_reward"), F.round("std_reward", 6).alias("std_reward"), "n")


CHANGE_SCHEMA = "op string, message_id string, subject string, body string, seq long"


@register("stream_index")
def q_stream_index(spark, sf_dir):
    """Index kept current from a change feed; inserts, updates and deletes of
    one message meet in one batch or come in several."""
    emails, _ = _tables(spark, sf_dir)
    o = F.col("id")
    insert = F.struct(F.lit("insert").alias("op"), "subject", "body", F.when(o % 3 == 0, 1).otherwise(0).cast("long").alias("seq"))
    update = F.when((o % 5 == 1) & (o % 3 != 0), F.struct(
        F.lit("update").alias("op"), F.concat(F.lit("updated "), F.col("subject")).alias("subject"), "body", F.lit(1).cast("long").alias("seq")))
    delete = F.when(o % 7 == 2, F.struct(F.lit("delete").alias("op"), F.lit(None).cast("string").alias("subject"),
                                         F.lit(None).cast("string").alias("body"), F.lit(2).cast("long").alias("seq")))
    rows = emails.select("message_id", F.inline(F.filter(F.array(delete, insert, update), lambda x: x.isNotNull())))
    changes, base = scratch_path(spark, "changes"), scratch_path(spark, "index")
    rows.select("op", "message_id", "subject", "body", "seq").repartition(6, "message_id", "seq").write.parquet(changes)
    sindex.run_change_feed(spark, changes, CHANGE_SCHEMA, base, scratch_path(spark, "ckpt-index"), files_per_batch=2)
    return sindex.live_postings(spark, base).select("term", "message_id", "field", F.col("pos").cast("int").alias("pos"))


@register("manifest_scan")
def q_manifest_scan(spark, sf_dir):
    """Manifest written with the sink (partitioned by split) and read back
    with its declared schema."""
    from ..sources import files, sinks
    s, pdfs, labels = _listings(spark, sf_dir)
    pairs = records.pair_by_stem(pdfs, labels)
    meta = s.select(F.col("stem").alias("patent_id"), F.col("record_id").alias("doc_id"), "split")
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    m = (pairs.join(meta, "patent_id").join(docs, "doc_id", "left")
         .select("patent_id", "pdf_path", "gold_json_path", F.coalesce("text", F.lit("")).alias("text"), "split"))
    path = scratch_path(spark, "manifest")
    sinks.write_manifests(m, path)
    back = files.read_manifest(spark, path)
    return back.select("patent_id", "pdf_path", "gold_json_path", F.length("text").alias("n_chars"), "split")


def _math_rule(name):
    def q(spark, sf_dir):
        return _scored_math(spark, sf_dir).select("prompt_id", "gen_idx", name)
    q.__name__ = f"q_{name}"
    return q


for _rule in ("format_exact", "format_approx", "answer_reward", "number_reward"):
    register(_rule)(_math_rule(_rule))


MAX_PROMPT_LENGTH = 2048


@register("prompt_truncation")
def q_prompt_truncation(spark, sf_dir):
    """Extraction prompts inside the prompt budget (whitespace tokens): the
    document is cut, the instructions before and after it stay; the completion
    budget is what is left of the sequence budget."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"], key="doc_id")
    head, tail = prompts.extraction_prompt_parts()
    room = MAX_PROMPT_LENGTH - len(head.split()) - len(tail.split())
    cut = sampling.first_tokens("text", room)
    return d.select("doc_id", prompts.ws_token_count("text").alias("n_tokens"),
                    F.least(prompts.ws_token_count("text"), F.lit(room)).alias("n_kept"),
                    F.concat(F.lit(head), cut, F.lit(tail)).alias("prompt"),
                    F.lit(MAX_SEQ_LENGTH * 2 - MAX_PROMPT_LENGTH).alias("max_completion_tokens"))
