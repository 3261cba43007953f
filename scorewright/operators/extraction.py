"""Structured-extraction reward over (completion, gold JSON) rows.

reward = clip(0.5 * validity + 0.4 * field_mean + 0.1 * constraints
              + 0.05 * format, 0, 1)

* validity: the completion holds a JSON object with every scored key;
* field_mean: mean similarity over the fields whose gold value is non-empty
  (null or blank string excluded; an empty list is kept), denominator
  ``max(1, n)``; similarity is 1 for equal normalised texts, 0 when exactly
  one is empty, else the Ratcliff-Obershelp ratio (gold first);
* constraints: filing <= published <= issued on each pair that parses;
  an object without dates gives 1, no object gives 0;
* format: 0.1 when the key set equals the scored list and every non-blank
  one of the four date fields is an ISO date.

The completion is parsed once by a strict Python JSON rule (Arrow UDF); every
other step is a column expression. Similarities are computed row-wise on the
14-element arrays: trivial pairs natively, the rest in one Arrow call per
batch, so there is no shuffle anywhere in the job. Gold JSON is parsed once
per prompt, before completions are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import collapse_ws, py_strip
from ..functions.udfs import field_scores, pair_ratio, parse_completion

def fields_arr() -> Column:
    return F.array(*[F.lit(f) for f in K.RELEVANT_FIELDS])


def norm_value(v: Column, max_len: int = K.NORM_MAX_LEN) -> Column:
    """null -> ''; lower; strip; collapse whitespace; cut to max_len after."""
    s = F.coalesce(v, F.lit(""))
    return F.substring(collapse_ws(py_strip(F.lower(s))), 1, max_len)


class _Field:
    """Kind, str() text and comparison form of one scored field of a parsed
    object (kind/value null when the key is absent or there is no object).
    The parse output is aligned to RELEVANT_FIELDS, so this is a positional
    lookup."""

    def __init__(self, parsed: str, name: str):
        p = F.col(parsed)
        idx = K.RELEVANT_FIELDS.index(name) + 1
        self.kind = F.element_at(p["fkinds"], idx)
        self.present = F.coalesce(self.kind.isNotNull(), F.lit(False))
        self.value = F.element_at(p["fvals"], idx)
        self.norm = F.coalesce(F.element_at(p["fnorms"], idx), F.lit(""))


def _field(parsed: str, name) -> _Field:
    return _Field(parsed, name)


def parse_gold(df: DataFrame, gold_json: str = "gold_json", out: str = "gold") -> DataFrame:
    return df.withColumn(out, parse_completion(F.col(gold_json)))


def parse_pred(df: DataFrame, completion: str = "completion", out: str = "pred") -> DataFrame:
    return df.withColumn(out, parse_completion(F.col(completion)))


def _py_date(v: Column) -> Column:
    """Date parse with strptime's three formats (one-digit month/day allowed
    for the delimited ones); input already stripped."""
    return F.coalesce(F.try_to_timestamp(v, F.lit("yyyy-M-d")),
                      F.try_to_timestamp(v, F.lit("yyyyMMdd")),
                      F.try_to_timestamp(v, F.lit("yyyy/M/d")))


def pred_date(pred: str, name: str) -> Column:
    f = _field(pred, name)
    ok = (f.kind == "string") & (f.value != "")
    return F.when(ok, _py_date(py_strip(f.value)))


def validity(pred: str = "pred") -> Column:
    keys = F.col(pred)["keys"]
    return F.when(keys.isNotNull() & (F.size(F.array_except(fields_arr(), keys)) == 0), 1.0).otherwise(0.0)


def constraints(pred: str = "pred") -> Column:
    fd, pd_, idt = (pred_date(pred, n) for n in K.ORDER_DATE_FIELDS)

    def le(a, b):
        return a.isNull() | b.isNull() | (a <= b)

    ok = le(fd, pd_) & le(fd, idt) & le(pd_, idt)
    return F.when(F.col(pred)["keys"].isNull(), 0.0).when(ok, 1.0).otherwise(0.0)


def format_bonus(pred: str = "pred") -> Column:
    keys = F.col(pred)["keys"]
    same = (keys.isNotNull() & (F.size(F.array_except(fields_arr(), keys)) == 0)
            & (F.size(F.array_except(keys, fields_arr())) == 0))
    iso_ok = F.lit(True)
    for name in K.ISO_DATE_FIELDS:
        f = _field(pred, name)
        skip = ~f.present | (f.kind == "null") | ((f.kind == "string") & (py_strip(f.value) == ""))
        good = (f.kind != "list") & F.try_to_timestamp(py_strip(f.value), F.lit("yyyy-M-d")).isNotNull()
        iso_ok = iso_ok & (skip | good)
    return F.when(same & iso_ok, F.lit(K.FORMAT_BONUS)).otherwise(0.0)


def with_field_similarities(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Adds ``field_used`` (gold non-empty flags), ``field_sims`` and
    ``field_mean`` over the 14 scored fields (one Arrow call per batch);
    sims are null and the mean 0 when the completion has no object."""
    fs = field_scores(F.col(gold)["fnorms"], F.col(gold)["fused"], F.col(pred)["fnorms"])
    df = df.withColumn("_fs", fs)
    return df.withColumns({
        "field_used": F.col(gold)["fused"],
        "field_sims": F.col("_fs")["sims"],
        "field_mean": F.coalesce(F.col("_fs")["mean"], F.lit(0.0)),
    }).drop("_fs")


def score_extraction(df: DataFrame, completion: str = "completion", gold: str = "gold",
                     weights=K.EXTRACTION_WEIGHTS) -> DataFrame:
    """Adds pred, validity, field_sims, field_used, field_mean, constraints,
    format and reward. ``gold`` must already be parsed (``parse_gold``)."""
    df = with_field_similarities(parse_pred(df, completion, "pred"), gold, "pred")
    w1, w2, w3, w4 = weights
    df = df.withColumns({
        "validity": validity("pred"),
        "constraints": constraints("pred"),
        "format": format_bonus("pred"),
    })
    raw = (F.lit(w1) * F.col("validity") + F.lit(w2) * F.col("field_mean")
           + F.lit(w3) * F.col("constraints") + F.lit(w4) * F.col("format"))
    return df.withColumn("reward", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def field_scores_long(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (row, used field) with its similarity."""
    z = F.arrays_zip(fields_arr().alias("field"), F.col("field_used").alias("used"), F.col("field_sims").alias("sim"))
    return (scored.filter(F.col("field_sims").isNotNull())
            .select(*keys, F.explode(z).alias("z"))
            .filter(F.col("z.used"))
            .select(*keys, F.col("z.field").alias("field"), F.col("z.sim").alias("sim")))


def field_pairs(parsed: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(gold_norm, pred_norm) of the used fields of rows with an object, as they
    come; nothing is scored."""
    g, p = F.col(gold), F.col(pred)
    z = F.arrays_zip(g["fnorms"].alias("g"), p["fnorms"].alias("p"), g["fused"].alias("u"))
    rows = parsed.filter(g["fnorms"].isNotNull() & p["fnorms"].isNotNull()).select(F.explode(z).alias("z")).filter("z.u")
    return rows.select(F.col("z.g").alias("gold_norm"), F.col("z.p").alias("pred_norm"))


def pair_similarities(pairs: DataFrame) -> DataFrame:
    """(gold_norm, pred_norm, sim): the table's dictionary of distinct pairs.
    Equal and empty texts are decided here; the matcher runs once for each
    distinct pair that is left, whatever the number of rows."""
    g, p = F.col("gold_norm"), F.col("pred_norm")
    open_ = (g != p) & (g != "") & (p != "")
    sim = F.when(g == p, F.lit(1.0)).when(open_, F.col("_ratio")).otherwise(F.lit(0.0))
    distinct = pairs.select("gold_norm", "pred_norm").distinct()
    scored = distinct.withColumn("_ratio", pair_ratio(F.when(open_, g), F.when(open_, p)))
    return scored.select("gold_norm", "pred_norm", sim.alias("sim"))


def date_format_profile(scored: DataFrame, fields=K.ISO_DATE_FIELDS) -> DataFrame:
    """Count of (field, format) over parsed completions: iso, compact, slash,
    unparsed or absent (null / blank / not a string)."""
    def fmt(name):
        f = _field("pred", name)
        s = py_strip(f.value)
        present = f.present & (f.kind == "string") & (f.value != "")
        return (F.when(~present, F.lit("absent"))
                .when(F.try_to_timestamp(s, F.lit("yyyy-M-d")).isNotNull(), F.lit("iso"))
                .when(F.try_to_timestamp(s, F.lit("yyyyMMdd")).isNotNull(), F.lit("compact"))
                .when(F.try_to_timestamp(s, F.lit("yyyy/M/d")).isNotNull(), F.lit("slash"))
                .otherwise(F.lit("unparsed")))
    arr = F.array(*[F.struct(F.lit(n).alias("field"), fmt(n).alias("format")) for n in fields])
    return (scored.filter(F.col("pred")["keys"].isNotNull())
            .select(F.explode(arr).alias("x"))
            .groupBy("x.field", "x.format").agg(F.count(F.lit(1)).alias("n")))
