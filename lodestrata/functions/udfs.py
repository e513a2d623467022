"""Extension points: registries of columns and vectorised functions, and those built-ins that need Python.

A ranker, a feature, a similarity, a transform or an evaluator is a function from columns to a column, so that it
stays in the query plan; only embedders and word-level correction run as pandas functions over Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKERS: dict[str, Callable[[], Column]] = {}
FEATURES: dict[str, tuple[str, str, Callable[[], Column]]] = {}
EMBEDDERS: dict[str, Callable[[Column], Column]] = {}
TRANSFORMS: dict[str, Callable[[Column], Column]] = {}
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {}
STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {}
#: Which ranker a consumer's queries use; others use the default.
DISPATCH = {"matching": "neural", "montage": "neural"}
DEFAULT_RANKER = "factored"
#: Allowed values by data type of a feature.
CHECKS = {
    "unit": lambda c: (c >= 0) & (c <= 1), "signed": lambda c: (c >= -1) & (c <= 1), "float": lambda c: ~F.isnan(c), "int": lambda c: c == F.floor(c),
    "bool": lambda c: c.isNotNull(),
}


def register_ranker(name: str, score: Callable[[], Column]) -> None:
    RANKERS[name] = score


def register_feature(name: str, subject: str, kind: str, compute: Callable[[], Column]) -> None:
    if kind not in CHECKS:
        raise ValueError(f"no data type {kind}")
    FEATURES[name] = (subject, kind, compute)


def register_embedder(name: str, embed_batch: Callable[[pd.Series], pd.Series]) -> None:
    """An embedder of batches of texts as a column function; nulls are empty texts."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield embed_batch(texts.fillna(""))

    EMBEDDERS[name] = run


def register_similarity(name: str, similarity: Callable[[Column, Column], Column]) -> None:
    SIMILARITIES[name] = similarity


def register_transform(name: str, transform: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = transform


def transformed(text: Column, *names: str) -> Column:
    for name in names:
        text = TRANSFORMS[name](text)
    return text


def verify(assertions: DataFrame, renderer: Callable[[], Column], similarity: str, least: float) -> DataFrame:
    """Assertions rendered as text and held against their ``evidence`` by a registered similarity."""
    rendered = assertions.withColumn("rendered", renderer())
    scored = rendered.withColumn("similarity", SIMILARITIES[similarity](F.col("rendered"), F.col("evidence")))
    return scored.withColumn("supported", F.col("similarity") >= least)


def coupling(x: Column, y: Column) -> Column:
    """Correlation of two series as an aggregate; 0 where either is constant."""
    r = F.corr(x, y)
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


def ranker_of(consumer: Column) -> Column:
    """Name of the ranker that a consumer's queries use."""
    out = F.lit(DEFAULT_RANKER)
    for kind, name in DISPATCH.items():
        out = F.when(consumer == kind, name).otherwise(out)
    return out


def register_step(name: str, step: Callable[[DataFrame], DataFrame]) -> None:
    STEPS[name] = step


def run_steps(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        df = df.transform(STEPS[name])
    return df


def rank(df: DataFrame, consumer: str, key: str) -> DataFrame:
    """Rows with their score by the consumer's ranker, the best first."""
    name = DISPATCH.get(consumer, DEFAULT_RANKER)
    return df.withColumn("score", RANKERS[name]()).withColumn("ranker", F.lit(name)).orderBy(F.desc("score"), key)


def compute(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The key and features side by side; a value outside its type becomes null."""
    out = []
    for name in names:
        _, kind, build = FEATURES[name]
        value = build()
        out.append(F.when(CHECKS[kind](value), value).alias(name))
    return df.select(key, *out)


def _defaults() -> None:
    from ..operators import retrieve as R
    from . import columns as c

    register_ranker("factored", R.factored_score)
    register_ranker("neural", lambda: R.neural_score(R.factored_score()))
    for name in ("heat", "recency", "canonicality", "fork", "faithfulness"):
        register_feature(name, "node", "unit", lambda n=name: F.col(n))
    register_feature("velocity", "node", "float", lambda: F.col("velocity"))
    SIMILARITIES["jaccard"] = lambda a, b: c.jaccard(c.token_set(a), c.token_set(b), 1.0)
    register_similarity("contained", lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(c.token_set(a), c.token_set(b))), F.size(c.token_set(a))), F.lit(0.0)))
    SIMILARITIES["rhyme"] = lambda a, b: c.rhyme(c.jaccard(c.token_set(a), c.token_set(b), 1.0))


_defaults()


# -- functions that need Python ----------------------------------------------------------------


def cold_start_vector(text: str, size: int = 256) -> np.ndarray:
    """A deterministic unit-scaled vector from chained SHA-512 bytes."""
    seed, raw = text.encode(), b""
    while len(raw) < size:
        seed = hashlib.sha512(seed).digest()
        raw += seed
    return np.frombuffer(raw[:size], np.uint8) / 127.5 - 1


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Cold-start embedding, batch by batch."""
    for texts in batches:
        yield texts.fillna("").map(lambda t: cold_start_vector(t).tolist())


register_embedder("cold_start", lambda texts: texts.map(lambda t: cold_start_vector(t).tolist()))
register_embedder("sha256", lambda texts: texts.map(lambda t: (np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8) / 127.5 - 1).tolist()))


def blake2b_hex(size: int = 8):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=size).hexdigest())

    return run


# Codes of feelings in the compressed dialect, and words that tell them.
FEELINGS = {"joy": ("happy", "joy", "glad"), "fear": ("afraid", "scared", "worried"), "love": ("love", "adore"), "grief": ("sad", "grief", "miss"), "rage": ("angry", "hate", "furious")}
FLAGS = {"DECISION": ("decided", "chose", "switched"), "ORIGIN": ("founded", "created", "started"), "TECHNICAL": ("api", "database", "code", "server")}


def compress(text: Column) -> Column:
    """A lossy one-line form: entity codes | topics | key sentence | feelings | flags."""
    low = F.lower(text)
    names = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,15})\b"), F.lit(1))), 1, 3)
    codes = F.array_join(F.transform(names, lambda n: F.upper(F.substring(n, 1, 3))), "+")
    topics = F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b([a-z]{5,})\b"), F.lit(1))), 1, 3), "_")
    sentences = F.filter(F.split(text, r"[.!?\n]+\s*"), lambda s: F.length(s) >= 10)
    key = F.substring(F.coalesce(F.get(sentences, 0), F.lit("")), 1, 55)

    def told(table: dict[str, tuple[str, ...]], most: int) -> Column:
        hits = [F.when(F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: low.contains(w)), F.lit(k)) for k, ws in table.items()]
        return F.array_join(F.slice(F.filter(F.array(*hits), lambda x: x.isNotNull()), 1, most), "+")

    return F.concat_ws("|", codes, topics, key, told(FEELINGS, 3), told(FLAGS, 3))
