"""Catalog: prompts, predictors, cache, cost estimate, over all three splits.

Training titles are random draws, so the text of training titles is left out of
the compared columns; everything else of the training rows is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import float_list_text, strip_ws
from ..operators import predict as PD
from ..operators import prompts as PT
from ..session import stage_path, stage_table
from ..sources import fixtures as FX
from ..sources import stores as ST
from . import oracle_sql as S
from .catalog import query
from .q_pipeline import FEATS, LABELS, PIPE_SQL, _dataset

PAD = "chr(10) || '            '"


def _fmt_list(c):
    return (f"string_agg(CASE WHEN x.{c} / NULLIF(fin.ref_{c}, 0) IS NULL THEN 'nan' "
            f"ELSE printf('%.4f', x.{c} / NULLIF(fin.ref_{c}, 0)) END, ', ' ORDER BY x.day_idx)")


PROMPT_SQL = PIPE_SQL + f""",
agg_p AS (SELECT fin.split, fin.ticker, fin.sample_id, fin.replica, fin.target, fin.ret, max(x.date) AS last_date,
    string_agg(dayname(x.date), ', ' ORDER BY x.day_idx) AS wd,
    {", ".join(f"{_fmt_list(c)} AS t_{c}" for c in FEATS)},
    string_agg('[' || coalesce(x.titles_repr, '') || ']', chr(10) ORDER BY x.day_idx) AS tb
  FROM fin JOIN x USING (split, ticker, sample_id, replica) GROUP BY ALL),
prompts AS (SELECT split, ticker, sample_id, replica, last_date, ret,
    ticker || ' - ' || strftime(last_date, '%Y-%m-%d') AS "index",
    chr(10) || '            Ticker: ' || ticker || {PAD} || 'Weekdays: ' || wd || {PAD} || 'Stock Data:'
      || {PAD} || '- Open Prices: ' || t_open || {PAD} || '- Close Prices: ' || t_close
      || {PAD} || '- Adjusted Close Prices: ' || t_adj_close || {PAD} || '- High Prices: ' || t_high
      || {PAD} || '- Low Prices: ' || t_low || {PAD} || '- Volume: ' || t_volume
      || {PAD} || 'News Titles:' || {PAD} || tb || {PAD}
      || 'Predict the expected stock return for the next day:' || chr(10) || '    ' AS prompt,
    target || chr(10) AS completion
  FROM agg_p)"""


HIDDEN = "News Titles: (drawn)"


def _prompts(spark, sf):
    return _dataset(spark, sf).select(
        "split", "ticker", "sample_id", "replica", F.element_at("date", -1).alias("date"),
        PT.sample_key().alias("index"), PT.prompt_text().alias("prompt"), F.concat("target", F.lit("\n")).alias("completion"))


def untitled(c="prompt"):
    """A prompt up to its titles."""
    return F.concat(F.substring_index(c, "News Titles:", 1), F.lit(HIDDEN))


def _shown(c="prompt"):
    return F.when(F.col("split") == "train", untitled(c)).otherwise(F.col(c))


def _untitled_sql(c="prompt"):
    return f"split_part({c}, 'News Titles:', 1) || '{HIDDEN}'"


_SHOWN_SQL = f"CASE WHEN split = 'train' THEN {_untitled_sql()} ELSE prompt END"
SPLITS = ("train", "val", "test")


@query("float_list_text", PIPE_SQL + f"""
SELECT fin.split, fin.ticker, fin.sample_id, {_fmt_list('open')} AS open_text, {_fmt_list('volume')} AS volume_text
, fin.replica FROM fin JOIN x USING (split, ticker, sample_id, replica)
GROUP BY fin.split, fin.ticker, fin.sample_id, fin.replica""")
def float_list_text_q(spark, sf):
    return _dataset(spark, sf).select("split", "ticker", "sample_id", "replica",
                                      float_list_text("open").alias("open_text"),
                                      float_list_text("volume").alias("volume_text"))


@query("sample_key", PIPE_SQL + """
SELECT fin.split, fin.ticker, fin.sample_id, fin.replica, fin.ticker || ' - ' || strftime(max(x.date), '%Y-%m-%d') AS "index"
FROM fin JOIN x USING (split, ticker, sample_id, replica) GROUP BY fin.split, fin.ticker, fin.sample_id, fin.replica""")
def sample_key(spark, sf):
    return _dataset(spark, sf).select("split", "ticker", "sample_id", "replica", PT.sample_key().alias("index"))


@query("prompt_build", PROMPT_SQL + f"""
SELECT split, "index", {_SHOWN_SQL} AS prompt, completion FROM prompts""")
def prompt_build(spark, sf):
    return _prompts(spark, sf).select("split", "index", _shown().alias("prompt"), "completion")


def _per_split(spark, sf, name, write):
    """Every split's file written and read back, as the training set is kept."""
    p = stage_table(_prompts(spark, sf), "prompts")
    out = None
    for split in SPLITS:
        path = ST.unique_path(stage_path(spark, name), split)
        back = write(p.filter(F.col("split") == split), path).withColumn("split", F.lit(split))
        out = back if out is None else out.unionByName(back)
    return out.select("split", "index", _shown().alias("prompt"), "completion")


@query("training_csv", PROMPT_SQL + f"""
SELECT split, "index", {_SHOWN_SQL} AS prompt, completion FROM prompts""")
def training_csv(spark, sf):
    return _per_split(spark, sf, "training_csv", ST.training_csv)


@query("training_jsonl", PROMPT_SQL + f"""
SELECT split, {_SHOWN_SQL} AS prompt, completion, "index" FROM prompts""")
def training_jsonl(spark, sf):
    return _per_split(spark, sf, "training_jsonl", ST.training_jsonl)


@query("dedupe_prompts", PROMPT_SQL + f"""
SELECT DISTINCT "index", {_untitled_sql()} AS prompt FROM prompts""")
def dedupe_prompts(spark, sf):
    p = _prompts(spark, sf)
    # the val prompts twice, as re-read tables would give them
    both = p.unionByName(p.filter(F.col("split") == "val"))
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return PD.dedupe_prompts(both.withColumn("split_rank", rank)).select("index", untitled().alias("prompt"))


_GT_SQL = f"""CASE WHEN ret > 0 THEN '{LABELS[-1]}' WHEN ret < 0 THEN '{LABELS[0]}' ELSE '{LABELS[len(LABELS) // 2]}' END"""


@query("predict_ground_truth", PROMPT_SQL + f"""
SELECT DISTINCT "index", {_GT_SQL} AS label FROM prompts""")
def predict_ground_truth(spark, sf):
    return PD.predict_ground_truth(_dataset(spark, sf), LABELS)


@query("prediction_lookup", PROMPT_SQL + f""",
t AS ({S.TRADES}),
gt AS (SELECT DISTINCT "index", {_GT_SQL} AS label FROM prompts)
SELECT t.account, t.date, t.symbol, t.side, gt.label FROM t LEFT JOIN gt ON gt."index" = t.symbol || ' - ' || strftime(t.date, '%Y-%m-%d')""")
def prediction_lookup(spark, sf):
    preds = PD.predict_ground_truth(_dataset(spark, sf), LABELS)
    req = FX.trades(spark, sf).select("account", "date", "symbol", "side")
    return PD.prediction_lookup(req, preds).select("account", "date", "symbol", "side", "label")


@query("predict_random", PROMPT_SQL + """
SELECT DISTINCT "index", true AS in_label_set FROM prompts""")
def predict_random(spark, sf):
    keys = _dataset(spark, sf).select(PT.sample_key().alias("index")).distinct()
    # the draw itself is a hash; every key gets a label of the set
    return PD.predict_random(keys, LABELS, seed=7).select("index", F.col("label").isin(*LABELS).alias("in_label_set"))


MODEL = "babbage-002"


@query("cache_misses", PROMPT_SQL + f"""
SELECT DISTINCT '{MODEL}' AS model, {_untitled_sql()} AS prompt FROM prompts WHERE split <> 'val'
  AND prompt NOT IN (SELECT prompt FROM prompts WHERE split = 'val')""")
def cache_misses(spark, sf):
    p = _prompts(spark, sf).withColumn("model", F.lit(MODEL))
    cache = p.filter(F.col("split") == "val").select("model", "prompt", strip_ws("completion").alias("completion"))
    return PD.cache_misses(p.select("model", "prompt"), cache).select("model", untitled().alias("prompt")).distinct()


def stub_scorer(model: str, prompt: str) -> str:
    """Deterministic stand-in for a remote model: reads the last open price
    of the prompt and answers with a label (used where no service exists)."""
    line = next(x for x in prompt.splitlines() if "Open Prices" in x)
    vals = [v for v in line.split(":", 1)[1].split(",")]
    last = vals[-1].strip()
    if last == "nan":
        raise ValueError("no price")          # exercised by the retry path
    v = float(last)
    return " " + ("very good" if v > 1.05 else "very bad" if v < 0.95 else "neutral") + "\n"


# the stub scorer in SQL: the last open price of the prompt, answered by a label
_STUB_SQL = """CASE WHEN v = 'nan' THEN NULL WHEN CAST(v AS DOUBLE) > 1.05 THEN 'very good'
  WHEN CAST(v AS DOUBLE) < 0.95 THEN 'very bad' ELSE 'neutral' END"""


@query("predict_batch", PROMPT_SQL + f""",
kept AS (SELECT prompt, min(regexp_replace(completion, '^\\s+|\\s+$', '', 'g')) AS completion FROM prompts WHERE split = 'val' GROUP BY prompt),
ask AS (SELECT "index", prompt, CASE WHEN trim(string_split(regexp_extract(prompt, '- Open Prices: ([^\\n]*)', 1), ',')[-1]) = 'nan' THEN 'nan'
          ELSE trim(string_split(regexp_extract(prompt, '- Open Prices: ([^\\n]*)', 1), ',')[-1]) END AS v
        FROM prompts),
got AS (SELECT ask."index", CASE WHEN kept.prompt IS NOT NULL THEN kept.completion ELSE {_STUB_SQL} END AS completion
        FROM ask LEFT JOIN kept ON kept.prompt = ask.prompt)
SELECT "index", '{MODEL}' AS model, completion,
  CASE WHEN list_contains({S.labels_sql(LABELS)}, completion) THEN completion END AS label FROM got""")
def predict_batch(spark, sf):
    p = _prompts(spark, sf).withColumn("model", F.lit(MODEL))
    cache = p.filter(F.col("split") == "val").select("model", "prompt", strip_ws("completion").alias("completion"))
    answers, _ = PD.predict_batch(p.select("index", "model", "prompt"), cache, PD.each(stub_scorer), LABELS)
    return answers.select("index", "model", "completion", "label")


@query("label_set_check", PROMPT_SQL + f""",
seen AS (SELECT DISTINCT regexp_replace(completion, '^\\s+|\\s+$', '', 'g') AS label FROM prompts),
conf AS (SELECT unnest({S.labels_sql(LABELS)}) AS label)
SELECT coalesce(seen.label, conf.label) AS label, seen.label IS NOT NULL AS in_data, conf.label IS NOT NULL AS in_config
FROM seen FULL OUTER JOIN conf ON seen.label = conf.label""")
def label_set_check(spark, sf):
    return PD.label_set_check(_prompts(spark, sf), LABELS)


def _tok_sql(c):
    return f"len(regexp_extract_all(coalesce({c}, ''), '{PD.TOKEN_PATTERN}'))"


@query("token_cost_estimate", PROMPT_SQL + f""",
tr AS (SELECT *, {_tok_sql('(' + _untitled_sql() + ')')} + {_tok_sql('completion')} AS t FROM prompts WHERE split = 'train'),
va AS (SELECT *, {_tok_sql('(' + _untitled_sql() + ')')} + {_tok_sql('completion')} AS t FROM prompts WHERE split = 'val'),
tail AS (SELECT t FROM tr ORDER BY last_date DESC, ticker DESC, replica DESC LIMIT (SELECT count(*) FROM va)),
s AS (SELECT (SELECT sum(t) FROM tr) AS train_tokens, (SELECT coalesce(sum(t), 0) FROM tail) AS train_tail_tokens,
             (SELECT sum(t) FROM va) AS val_tokens)
SELECT '{MODEL}' AS model, CAST(train_tokens AS BIGINT) AS train_tokens, CAST(train_tail_tokens AS BIGINT) AS train_tail_tokens,
  CAST(val_tokens AS BIGINT) AS val_tokens,
  round(train_tokens * {PD.TRAINING_COST_PER_1000[MODEL]} * 4 / 1000.0, 6) AS train_cost,
  round(train_tail_tokens * {PD.INFERENCE_COST_PER_1000[MODEL]} / 1000.0, 6) AS train_inference_cost,
  round(val_tokens * {PD.INFERENCE_COST_PER_1000[MODEL]} / 1000.0, 6) AS val_cost,
  round(train_tokens * {PD.TRAINING_COST_PER_1000[MODEL]} * 4 / 1000.0
        + (train_tail_tokens + val_tokens) * {PD.INFERENCE_COST_PER_1000[MODEL]} / 1000.0, 6) AS total_cost,
  train_tokens * {PD.TRAINING_COST_PER_1000[MODEL]} * 4 / 1000.0
        + (train_tail_tokens + val_tokens) * {PD.INFERENCE_COST_PER_1000[MODEL]} / 1000.0 <= 2 AS within_budget
FROM s""")
def token_cost_estimate(spark, sf):
    """Training on the train frame, inference over its tail and over val; titles are
    not counted, as those of train are random draws."""
    p = stage_table(_prompts(spark, sf).withColumn("prompt", untitled()), "prompts")
    est = PD.token_cost_estimate(p.filter(F.col("split") == "train"), p.filter(F.col("split") == "val"),
                                 MODEL, epochs=None, budget=2)
    from .catalog import r6
    return est.select("model", F.col("train_tokens").cast("bigint").alias("train_tokens"),
                      F.col("train_tail_tokens").cast("bigint").alias("train_tail_tokens"),
                      F.col("val_tokens").cast("bigint").alias("val_tokens"),
                      *[r6(c).alias(c) for c in ("train_cost", "train_inference_cost", "val_cost", "total_cost")],
                      "within_budget")


@query("null_row_report", PROMPT_SQL + """
SELECT count(*) AS rows_before, count(*) FILTER (WHERE "index" IS NOT NULL AND prompt IS NOT NULL AND completion IS NOT NULL) AS rows_after,
  count(*) FILTER (WHERE "index" IS NULL) AS null_index, count(*) FILTER (WHERE prompt IS NULL) AS null_prompt,
  count(*) FILTER (WHERE completion IS NULL) AS null_completion,
  count(*) - count(*) FILTER (WHERE "index" IS NOT NULL AND prompt IS NOT NULL AND completion IS NOT NULL) AS rows_dropped
FROM prompts""")
def null_row_report(spark, sf):
    from ..operators.quality import null_profile
    return null_profile(_prompts(spark, sf).select("index", "prompt", "completion"))


@query("train_tail_rows", PROMPT_SQL + """
SELECT "index", replica FROM prompts WHERE split = 'train'
ORDER BY last_date DESC, ticker DESC, replica DESC LIMIT (SELECT count(*) FROM prompts WHERE split = 'val')""")
def train_tail_rows(spark, sf):
    """As many of the train frame's last rows as val has."""
    p = stage_table(_prompts(spark, sf).select("split", "index", "date", "ticker", "replica"), "prompt-keys")
    n = p.filter(F.col("split") == "val").agg(F.count(F.lit(1)).alias("_n"))
    return PD.tail_rows(p.filter(F.col("split") == "train"), n).select("index", "replica")


@query("predictor_interface", PROMPT_SQL + f""",
t AS ({S.TRADES}),
gt AS (SELECT DISTINCT "index", {_GT_SQL} AS label FROM prompts)
SELECT t.account, t.date, t.symbol, gt.label FROM t LEFT JOIN gt ON gt."index" = t.symbol || ' - ' || strftime(t.date, '%Y-%m-%d')""")
def predictor_interface(spark, sf):
    ds = _dataset(spark, sf)
    parts = [ds.filter(F.col("split") == s) for s in ("train", "val", "test")]
    pred = PD.GroundTruthPredictor(LABELS).fit(*parts)
    req = FX.trades(spark, sf).select("account", "date", "symbol")
    return pred.transform(req).select("account", "date", "symbol", "label")
