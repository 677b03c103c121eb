"""Predictors as joins: ground truth, random, cached batch scoring."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, strip_ws
from .prompts import sample_key
from ..session import stage_table
from .util import one_row_join

# Price per 1000 tokens (training, inference) per model.
TRAINING_COST_PER_1000 = {"davinci-002": 0.006, "babbage-002": 0.0004}
INFERENCE_COST_PER_1000 = {"davinci-002": 0.012, "babbage-002": 0.0016}
TOKEN_PATTERN = r"\w+|[^\w\s]"


def sign_label(ret, labels: Sequence[str]):
    r = F.col(ret) if isinstance(ret, str) else ret
    return (F.when(r > 0, F.lit(labels[-1])).when(r < 0, F.lit(labels[0]))
             .otherwise(F.lit(labels[len(labels) // 2])))


def predict_ground_truth(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(index, label) from the sign of the return, over all given splits,
    duplicates (replicas, overlapping frames) removed.  A NULL return takes
    the middle label, like NaN in the reference."""
    return samples.select(sample_key().alias("index"), sign_label("return", labels).alias("label")).distinct()


def predict_random(keys: DataFrame, labels: Sequence[str], seed: int = 0,
                   key_col: str = "index") -> DataFrame:
    """Uniform label per key from a repeatable hash."""
    lab = F.array(*[F.lit(x) for x in labels])
    i = F.floor(hash_uniform(seed, key_col) * len(labels)).cast("int")
    return keys.select(key_col, F.element_at(lab, i + 1).alias("label"))


def prediction_lookup(requests: DataFrame, predictions: DataFrame, stock="symbol",
                      date="date") -> DataFrame:
    """Label of each (stock, date) request by its key; NULL without a sample."""
    req = requests.withColumn("index", sample_key(F.col(stock), F.col(date)))
    return req.join(predictions, "index", "left")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(model, prompt) pairs not completed yet."""
    return requests.select("model", "prompt").distinct().join(
        cache.select("model", "prompt"), ["model", "prompt"], "left_anti")


BatchScorer = Callable[[str, list[str]], Sequence[str | None]]


def each(scorer: Callable[[str, str], str]) -> BatchScorer:
    """A batch scorer from one that takes a prompt at a time; a call that raises
    leaves its prompt without an answer."""
    def run(model: str, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            try:
                out.append(scorer(model, p))
            except Exception:  # noqa: BLE001 - a failed call is retried
                out.append(None)
        return out
    return run


def _takes_one(scorer: Callable) -> bool:
    """Whether the scorer's second parameter is named `prompt`: one prompt a call."""
    try:
        names = list(inspect.signature(scorer).parameters)
    except (TypeError, ValueError):                # a callable without a signature
        return False
    return names[1:2] == ["prompt"]


def _score_partition(scorer: BatchScorer, retries: int, size: int):
    if _takes_one(scorer):
        scorer = each(scorer)

    def run(batches):
        for pdf in batches:
            answers: dict[tuple, str | None] = {}
            for model, prompts in pdf.groupby("model", dropna=False)["prompt"]:
                left = list(prompts)
                for _ in range(retries):
                    missed: list[str] = []
                    for at in range(0, len(left), size):
                        part = left[at:at + size]
                        try:
                            got = list(scorer(model, part))
                        except Exception:  # noqa: BLE001 - a failed call is retried
                            got = [None] * len(part)
                        if len(got) != len(part):
                            raise ValueError(f"the scorer gave {len(got)} answers to {len(part)} prompts")
                        for p, a in zip(part, got):
                            if a is None:
                                missed.append(p)
                            else:
                                answers[model, p] = a.strip()
                    left = missed
                    if not left:
                        break
            pairs = zip(pdf["model"], pdf["prompt"])
            yield pd.DataFrame({"model": pdf["model"], "prompt": pdf["prompt"],
                                "completion": [answers.get(k) for k in pairs]})
    return run


def predict_batch(requests: DataFrame, cache: DataFrame, scorer: BatchScorer,
                  labels: Sequence[str], retries: int = 3,
                  cache_path: str | None = None, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """Completions for (model, prompt) requests.

    Cache hits are reused; the distinct misses go through `scorer`, which takes a
    model and up to `size` prompts at a time and gives an answer, or None, for each
    (`each` makes one of a scorer for single prompts, and is applied here to one
    whose second parameter is named `prompt`).  Prompts without an answer are asked
    again, up to `retries` times in all; a call that raises answers none.
    Returns (answers, new_cache_rows): what stays unanswered is NULL and is not
    cached; an answer outside `labels` is kept in the cache but labelled NULL.
    Each miss is scored once; with `cache_path` the new rows are appended to the
    cache table there.  Of a cache's repeats the least completion is used.  NULL
    models or prompts are not asked and have no answer.
    """
    misses = cache_misses(requests, cache).filter(F.col("model").isNotNull() & F.col("prompt").isNotNull())
    # written once: answers and cache rows come from the same calls
    scored = stage_table(misses.mapInPandas(_score_partition(scorer, retries, size),
                                            "model string, prompt string, completion string"), "scored")
    fresh = scored.filter(F.col("completion").isNotNull())
    cached = cache.groupBy("model", "prompt").agg(F.min("completion").alias("completion"))
    known = cached.unionByName(scored)
    if cache_path is not None:
        fresh.write.mode("append").parquet(cache_path)
    lab = F.array(*[F.lit(x) for x in labels])
    answers = requests.join(known, ["model", "prompt"], "left").withColumn(
        "label", F.when(F.array_contains(lab, F.col("completion")), F.col("completion")))
    return answers, fresh


def dedupe_prompts(prompts: DataFrame, order: Sequence[str] = ("split_rank", "prompt")) -> DataFrame:
    """Distinct (index, prompt); the prompt a key resolves to is the first by
    an explicit order."""
    from pyspark.sql import Window
    d = prompts.select("index", "prompt", *[c for c in order if c != "prompt"]).distinct()
    w = Window.partitionBy("index").orderBy(*order)
    return d.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("index", "prompt")


def label_set_check(prompts: DataFrame, labels: Sequence[str], spark=None) -> DataFrame:
    """Per label: seen in the completions (stripped) and/or configured."""
    spark = spark or prompts.sparkSession
    seen = prompts.select(strip_ws("completion").alias("label")).distinct() \
                  .withColumn("in_data", F.lit(True))
    conf = spark.createDataFrame([(x,) for x in labels], "label string").withColumn("in_config", F.lit(True))
    return seen.join(conf, "label", "full").select(
        "label", F.coalesce("in_data", F.lit(False)).alias("in_data"),
        F.coalesce("in_config", F.lit(False)).alias("in_config"))


def token_count(c) -> F.Column:
    """Pluggable token counter: words and punctuation marks."""
    return F.regexp_count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(TOKEN_PATTERN))


def tail_rows(df: DataFrame, n: DataFrame, date_col: str = "date",
              tie_cols: Sequence[str] = ("ticker", "replica")) -> DataFrame:
    """The last n rows of `df` by (date, ties...), n from a one-row table; NULL dates
    and ties stand before all others, and a hash of the whole row decides last.

    Counts per day (one row a day) give the day the cut falls on; later days are
    taken whole.  The rows of that one day are range-partitioned by the ties, each
    counted within its range, and the ranges' counts (one row a range) give every
    row its place: no window holds a day, and no more than the day is sorted."""
    from pyspark.sql import Window
    per_day = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_c"))
    later = F.sum("_c").over(Window.orderBy(F.col(date_col).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    days = one_row_join(per_day.withColumn("_after", F.coalesce(later, F.lit(0))), n)
    on_cut = (F.col("_after") < F.col("_n")) & (F.col("_after") + F.col("_c") > F.col("_n"))
    # one row: the day that is cut and what it gives, or none, where days are whole
    cut = days.agg(F.max(F.when(on_cut, F.struct(F.col(date_col).alias("day"), (F.col("_n") - F.col("_after")).alias("take")))).alias("_cut"),
                   F.min(F.when(F.col("_after") + F.col("_c") <= F.col("_n"), F.struct(F.col(date_col).isNotNull(), F.col(date_col).alias("day")))).alias("_last"))
    marked = one_row_join(df, cut)
    last = F.col("_last.day")
    whole = F.col("_last").isNotNull() & (last.isNull() | (F.col(date_col) >= last))
    the_day = F.col("_cut").isNotNull() & F.col(date_col).eqNullSafe(F.col("_cut.day"))
    order = [*[F.col(c).desc_nulls_last() for c in tie_cols], F.xxhash64(*[F.col(c) for c in df.columns]).desc()]
    placed = stage_table(
        marked.filter(the_day).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()), "tail-day")
    # the id is (partition, row of it)
    placed = placed.withColumns({"_part": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND((1 << 33) - 1)})
    held = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offset = held.select("_part", F.coalesce(before, F.lit(0)).alias("_off"))
    of_day = placed.join(offset, "_part").filter(F.col("_off") + F.col("_row") < F.col("_cut.take"))
    return marked.filter(whole).select(*df.columns).unionByName(of_day.select(*df.columns))


def token_cost_estimate(train: DataFrame, val: DataFrame, model: str, epochs: int | None = None,
                        budget: float | None = None, date_col: str = "date",
                        tie_cols: Sequence[str] = ("ticker", "replica")) -> DataFrame:
    """Training cost over train, inference over the last len(val) train rows
    (ordered by date, then ties) and over val; one row with the budget check."""
    epochs = epochs or 4
    def tok(df):
        return df.withColumn("_t", token_count("prompt") + token_count("completion"))
    n_val = val.agg(F.count(F.lit(1)).alias("_n"))
    t_sum = tok(train).agg(F.sum("_t").alias("train_tokens"))
    tail_sum = tok(tail_rows(train, n_val, date_col, tie_cols)).agg(
        F.coalesce(F.sum("_t"), F.lit(0)).alias("train_tail_tokens"))
    v_sum = tok(val).agg(F.sum("_t").alias("val_tokens"))
    out = one_row_join(one_row_join(t_sum, tail_sum), v_sum)
    tp, ip = TRAINING_COST_PER_1000[model], INFERENCE_COST_PER_1000[model]
    out = out.select(
        F.lit(model).alias("model"), "train_tokens", "train_tail_tokens", "val_tokens",
        (F.col("train_tokens") * tp * epochs / 1000.0).alias("train_cost"),
        (F.col("train_tail_tokens") * ip / 1000.0).alias("train_inference_cost"),
        (F.col("val_tokens") * ip / 1000.0).alias("val_cost"))
    out = out.withColumn("total_cost", F.col("train_cost") + F.col("train_inference_cost") + F.col("val_cost"))
    if budget is not None:
        out = out.withColumn("within_budget", F.col("total_cost") <= F.lit(float(budget)))
    return out


class Predictor:
    """The reference's predictor interface as a table transform: `fit` gets
    the sample tables, `transform` labels a request table (NULL when the
    predictor has no answer), `labels` lists the label set."""

    def __init__(self, labels: Sequence[str]):
        self._labels = list(labels)

    def labels(self) -> list[str]:
        return list(self._labels)

    def fit(self, *samples: DataFrame) -> "Predictor":
        return self

    def transform(self, requests: DataFrame, stock: str = "symbol", date: str = "date") -> DataFrame:
        raise NotImplementedError


class GroundTruthPredictor(Predictor):
    def fit(self, *samples: DataFrame) -> "Predictor":
        u = samples[0]
        for s in samples[1:]:
            u = u.unionByName(s, allowMissingColumns=True)
        self._truth = predict_ground_truth(u, self._labels)
        return self

    def transform(self, requests, stock="symbol", date="date"):
        return prediction_lookup(requests, self._truth, stock, date)


class RandomPredictor(Predictor):
    def __init__(self, labels, seed: int = 0):
        super().__init__(labels)
        self.seed = seed

    def transform(self, requests, stock="symbol", date="date"):
        keyed = requests.withColumn("index", sample_key(F.col(stock), F.col(date)))
        lab = predict_random(keyed.select("index").distinct(), self._labels, self.seed)
        return keyed.join(lab, "index", "left")
