"""Full-text lookups, diversity re-ranking and intents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import mmr_similarity
from ..sources.tables import cut


def trigrams(c: Column) -> Column:
    """Distinct three-character pieces of the lower-cased text, by a lookahead: linear in its length."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?s)(?=(...))"), F.lit(1)))


def trigram_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """gram, key: an inverted index; write it partitioned or bucketed by gram to look up without a scan."""
    return df.select(F.explode(trigrams(F.col(text))).alias("gram"), F.col(key))


#: Rows of an index, about, that one task sorts.
TASK_GRAMS = 4_000_000


def dealt_by_gram(index: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """The index of df's texts, dealt by gram over as many tasks as its rows, at most one a character, need. A gram that more
    rows may have than a quarter of what a task sorts is dealt by the key, too."""
    n, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_GRAMS))
    return index.repartition(tasks, "gram", F.pmod(F.xxhash64(key), F.lit(max(1, -(-4 * n // TASK_GRAMS)))))


def word_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """word, key of lower-cased runs of letters and digits."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return df.select(F.explode(words).alias("word"), F.col(key))


def refresh(index: DataFrame, df: DataFrame, key: str, fresh: DataFrame) -> DataFrame:
    """Index rows of df's keys are replaced by fresh ones, so repeated runs don't add up."""
    return index.join(df.select(key).distinct(), key, "left_anti").select(*index.columns).unionByName(fresh.select(*index.columns))


def contains(df: DataFrame, index: DataFrame | None, key: str, text: str, needle: str) -> DataFrame:
    """Rows whose text contains the needle, ignoring case. Keys that have all its trigrams are candidates;
    the text confirms. Without an index, and for needles under three characters, the texts are scanned."""
    low = needle.lower()
    hit = F.contains(F.lower(F.col(text)), F.lit(low))
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams or index is None:
        return df.filter(hit)
    found = index.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(grams))
    return df.join(found.select(key), key, "left_semi").filter(hit)


#: Candidates of a query that one task compares; those of larger ones are joined pair by pair.
TASK_CANDIDATES = 512


def alike_within(df: DataFrame, query: str, key: str, day: str, tags: str) -> DataFrame:
    """query, a, b, sim (`mmr_similarity`) of all a < b of each query. The pairs of a query of up to TASK_CANDIDATES rows are
    products of its rows' tags inside a task."""
    kinds = dict(df.dtypes)
    rows = df.filter(F.col(query).isNotNull() & F.col(key).isNotNull()).select(query, F.col(key).alias("__k"), F.col(day).alias("__d"), F.col(tags).alias("__t"))
    large = cut(rows.groupBy(query).count().filter(F.col("count") > TASK_CANDIDATES).select(query), "large-queries")
    a, b = (rows.join(large, query).select(query, *[F.col(f"__{c}").alias(f"{c}{s}") for c in "kdt"]) for s in "ab")
    joined = a.join(b, query).filter("ka < kb").select(query, F.col("ka").alias("a"), F.col("kb").alias("b"), mmr_similarity("da", "db", "ta", "tb").alias("sim"))

    def pairs(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t["__k"]))
        words, days = t["__t"].combine_chunks(), t["__d"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode(null_encoding="encode")
        has = np.zeros((len(n), max(1, len(flat.dictionary))), np.float32)
        has[np.repeat(np.arange(len(n)), n), flat.indices.to_numpy()] = 1
        i, j = np.triu_indices(len(n), 1)
        same, size = (has @ has.T)[i, j].astype(float), has.sum(axis=1, dtype=float)
        with np.errstate(invalid="ignore"):
            near = np.where((size[i] > 0) & (size[j] > 0), same / (size[i] + size[j] - same), 0.0)
        a, b = t["__k"].take(pa.array(i)), t["__k"].take(pa.array(j))
        out = pa.table({query: t[query].take(pa.array(i)), "a": a, "b": b, "sim": pa.array(0.5 * (days[i] == days[j]) + 0.5 * near)})
        return out.filter(pc.less(a, b))

    few = rows.join(large, query, "left_anti").groupBy(query).applyInArrow(pairs, f"{query} {kinds[query]}, a {kinds[key]}, b {kinds[key]}, sim double")
    return few if large.isEmpty() else few.unionByName(joined)


def _greedy(pdf: pd.DataFrame, k: int, weight: float) -> pd.DataFrame:
    """id, pick of the k picks among rows with their query's least, most and n."""
    rows = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    days, tags = rows["day"].tolist(), [frozenset(t) if t is not None else frozenset() for t in rows["tags"]]
    span = max(rows["most"].iloc[0] - rows["least"].iloc[0], 1e-12)
    value = ((rows["score"] - rows["least"]) / span).tolist()

    def alike(i: int, j: int) -> float:
        same = 0.5 if (days[i] == days[j] or (pd.isna(days[i]) and pd.isna(days[j]))) else 0.0
        both = tags[i] and tags[j]
        return same + (0.5 * len(tags[i] & tags[j]) / len(tags[i] | tags[j]) if both else 0.0)

    left, chosen = list(range(len(rows))), []
    near = [0.0] * len(rows)
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (weight * value[i] - (1 - weight) * near[i], -i))
        left.remove(best)
        chosen.append(best)
        for i in left:
            near[i] = max(near[i], alike(i, best))
    return pd.DataFrame({"id": rows["id"].iloc[chosen].tolist(), "pick": range(1, len(chosen) + 1)})


def rerank(df: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """query, id, rank of all rows (query, id, score, day, tags; an id once a query): k picks by greedy
    diversity, then the others by score. Up to k + 5 rows keep their order. Rows of one day and tag set
    are equally near to any pick, so only the best k of each such class can be picked: a query's group has
    k rows a class, whatever its number of rows. The others are numbered by a distributed position."""
    from .relational import positions, top

    kinds = dict(df.dtypes)
    stats = df.groupBy("query").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("n")).filter(F.col("n") > k + 5)
    order = [F.col("score").desc(), F.col("id")]
    classed = df.withColumn("__tags", F.array_sort(F.array_distinct(F.coalesce("tags", F.expr("cast(array() as " + kinds["tags"] + ")")))))
    best = top(classed, ["query", "day", "__tags"], order, k).drop("__tags").join(stats, "query")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _greedy(pdf, k, weight)
        out.insert(0, "query", key[0])
        return out

    # Written, as the picks are read four times and the greedy choice should run once.
    picks = cut(best.groupBy("query").applyInPandas(run, f"query {kinds['query']}, id {kinds['id']}, pick long"), "picks")
    taken = picks.groupBy("query").agg(F.count("*").alias("taken"))
    others = positions(df.select("query", "id", "score").join(picks, ["query", "id"], "left_anti"), [F.col("query"), *order], "__at")
    first = others.groupBy("query").agg(F.min("__at").alias("__first"))
    offset = first.join(taken, "query", "left").select("query", (F.coalesce("taken", F.lit(0)) + 1 - F.col("__first")).alias("__offset"))
    rest = others.join(offset, "query").select("query", "id", (F.col("__at") + F.col("__offset")).alias("rank"))
    return picks.select("query", "id", F.col("pick").alias("rank")).unionByName(rest)


#: Words by which a plain request names a kind of media, and an unconfirmed identity.
PHOTO_WORDS, VIDEO_WORDS = ("照片", "相片", "photo"), ("视频", "录像", "video")


def intent(text: Column, people: list[str], scenes: list[str]) -> Column:
    """media_type, year, people, scenes of a plain request, by rules; unknown parts are null or empty."""
    has = lambda words: [F.contains(F.lower(text), F.lit(w.lower())) for w in words]

    def any_(cs: list[Column]) -> Column:
        out = F.lit(False)
        for c in cs:
            out = out | c
        return out

    named = lambda words: F.array_compact(F.array(*[F.when(h, w) for h, w in zip(has(words), words)]).cast("array<string>"))
    year = F.nullif(F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.lit(""))
    return F.struct(
        F.when(any_(has(VIDEO_WORDS)), "video").when(any_(has(PHOTO_WORDS)), "photo").alias("media_type"),
        year.cast("int").alias("year"), named(people).alias("people"), named(scenes).alias("scenes"),
    )


def by_intent(assets: DataFrame, wanted: dict, confirmed: DataFrame) -> tuple[DataFrame, bool]:
    """Assets (asset_id, media_type, day, people, tags) that fit an intent, and whether the request is
    blocked: people whose identity isn't confirmed (person) block it and give no rows."""
    out = assets
    names = list(wanted.get("people") or [])
    if names:
        known = {r[0] for r in confirmed.filter(F.col("person").isin(names)).select("person").distinct().collect()}
        if set(names) - known:
            return assets.limit(0), True
        out = out.filter(F.size(F.array_intersect("people", F.array(*map(F.lit, names)))) == len(names))
    if wanted.get("media_type"):
        out = out.filter(F.col("media_type") == wanted["media_type"])
    if wanted.get("year"):
        out = out.filter(F.year("day") == int(wanted["year"]))
    if wanted.get("scenes"):
        out = out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, wanted["scenes"]))))
    return out, False

