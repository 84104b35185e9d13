"""Votes, audits, rules, cascades and evaluation measures."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import age_bin, dot, last_folder, normalised
from ..sources.tables import cut
from .relational import hash_order, positions
from .sweep import before


# Votes and audits ---------------------------------------------------------------------------------------
def vote(neighbours: DataFrame, k: int, ratio: float | Column = 0.6, margin: int = 2, least: float = 0.0) -> DataFrame:
    """query, label, votes, second, share, decision of kNN rows (query, label, sim): neighbours below
    `least` don't vote; the top label needs share >= ratio of k and a lead of margin, else the row says
    `abstain_empty`, `abstain_margin` or `abstain_ratio`. Ties go to the smaller label."""
    ratio = ratio if isinstance(ratio, Column) else F.lit(ratio)
    counts = neighbours.withColumn("ok", (F.col("sim") >= least).cast("int")).groupBy("query", "label").agg(F.sum("ok").alias("votes"))
    w = Window.partitionBy("query").orderBy(F.col("votes").desc(), "label")
    best = counts.withColumns({"rn": F.row_number().over(w), "second": F.coalesce(F.lead("votes").over(w), F.lit(0))}).filter("rn = 1")
    share = F.col("votes") / F.lit(k)
    decision = (
        F.when(F.col("votes") == 0, "abstain_empty").when(F.col("votes") - F.col("second") < margin, "abstain_margin").when(share < ratio, "abstain_ratio").otherwise("assign")
    )
    return best.select("query", "label", "votes", "second", share.alias("share"), decision.alias("decision"))


def child_ratio(is_child: Column, ratio: float = 0.6, more: float = 0.1, most: float = 0.85) -> Column:
    """Children need a clearer majority."""
    return F.when(is_child, F.least(F.lit(ratio + more), F.lit(most))).otherwise(F.lit(ratio))


def own_and_other(scores: DataFrame) -> DataFrame:
    """query, own, own_score, other, other_score of class scores (query, own, label, score): the best other
    class, ties to the smaller label."""
    mine = scores.filter("label = own").select("query", "own", F.col("score").alias("own_score"))
    other = scores.filter("label != own").groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("o"))
    return mine.join(other, "query").select("query", "own", "own_score", F.col("o.label").alias("other"), (-F.col("o.s")).alias("other_score"))


def conflicts(compared: DataFrame, margin: float = 0.03, floor: float = 0.5) -> DataFrame:
    return compared.filter((F.col("other_score") - F.col("own_score") >= margin) & (F.col("other_score") >= floor))


def ambiguous(compared: DataFrame, band: float = 0.03) -> DataFrame:
    return compared.filter(F.abs(F.col("own_score") - F.col("other_score")) <= band)


def paradox(gender: Column, expected_gender: Column, age: Column, expected_age: Column, years: float = 3.0) -> Column:
    """gender before age; null where neither contradicts."""
    return F.when(gender != expected_gender, "gender").when(F.abs(age - expected_age) > years, "age")


# Rules --------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class TextRule:
    pattern: str
    weight: int
    tag: str


#: Weights of file-name rules are replaced by these: the sensitive tag's, and the others'.
SENSITIVE_NAME, PLAIN_NAME = 5, 2


def rule_score(text: Column, rules: list[TextRule], name: Column | None = None, name_rules: list[TextRule] = (), sensitive_tag: str = "") -> tuple[Column, Column]:
    """Score and reasons (joined by +). A rule counts once; patterns are case-sensitive regular expressions."""
    t = F.coalesce(F.trim(text), F.lit(""))
    score, tags = F.lit(0), []
    for r in rules:
        hit = t.rlike(r.pattern)
        score = score + F.when(hit, r.weight).otherwise(0)
        tags.append(F.when(hit, r.tag))
    if name is not None:
        n = F.coalesce(name, F.lit(""))
        for r in name_rules:
            hit = n.rlike(r.pattern)
            score = score + F.when(hit, SENSITIVE_NAME if r.tag == sensitive_tag else PLAIN_NAME).otherwise(0)
            tags.append(F.when(hit, r.tag))
    return score, F.concat_ws("+", *tags)


def cascade(score: Column, described: Column, is_video: Column, strong: int = 10, review: int = 5) -> Column:
    """auto at the strong score, review at the lower one or for a video without a description, else below."""
    return F.when(score >= strong, "auto").when((score >= review) | (is_video & ~described), "review").otherwise("below")


def after_review(level: Column) -> Column:
    return F.when(level >= 2, "add").otherwise("skipped")


#: Names and folders of screenshots, downloads and screen recordings.
SCREENSHOT_PREFIXES = ("screenshot", "screen_")
SCREENSHOT_NAMES = ("截图", "屏幕截图", "screencapture")
SCREENSHOT_PATHS = ("/screenshots/", "截图", "截屏", "screenshot")
DOWNLOAD_FOLDERS = ("download", "downloads", "下载", "baidunetdisk")
RECORDING_NAMES = ("screenrecording", "录屏", "screen record")


def junk_reasons(name: Column, path: Column) -> Column:
    """0 to 4 reasons, in a fixed order. The download rule looks at the last folder only."""
    n, p = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))

    def any_of(c: Column, parts, how) -> Column:
        out = F.lit(False)
        for x in parts:
            out = out | how(c, F.lit(x))
        return out

    return F.array_compact(
        F.array(
            F.when(any_of(n, SCREENSHOT_PREFIXES, F.startswith) | any_of(n, SCREENSHOT_NAMES, F.contains), "SCREENSHOT_FILENAME"),
            F.when(F.startswith(p, F.lit("screenshots/")) | any_of(p, SCREENSHOT_PATHS, F.contains), "SCREENSHOT_PATH"),
            F.when(last_folder(p).isin(*DOWNLOAD_FOLDERS), "DOWNLOAD_PATH"),
            F.when(any_of(n, RECORDING_NAMES, F.contains), "SCREEN_RECORDING_FILENAME"),
        )
    )


def log_profile(name: Column) -> Column:
    """camera, profile, confidence, is_log by a video's name (fixed names and confidences); is_log is null where the picture must decide,
    and the struct is null without a hint."""
    low = F.lower(F.coalesce(name, F.lit("")))

    def found(camera, profile: str, confidence: float, is_log: int | None) -> Column:
        camera = camera if isinstance(camera, Column) else F.lit(camera)
        return F.struct(camera.alias("camera"), F.lit(profile).alias("profile"), F.lit(confidence).alias("confidence"), F.lit(is_log).cast("int").alias("is_log"))

    ends = lambda *x: F.lit(False) if not x else F.endswith(low, F.lit(x[0])) | ends(*x[1:])
    return (
        F.when(ends("_d.mp4", "_d.jpg", "_d.mov"), found("DJI", "dlog", 0.95, 1))
        .when(ends(".insp", ".insv"), found("Insta360", "flat", 0.90, 1))
        .when(low.contains("dji") | low.contains("insta360"), found(F.when(low.contains("dji"), "DJI").otherwise("Insta360"), "unknown", 0.30, None))
        .when((low.startswith("vid_") & low.contains("_00_")) | low.startswith("gx"), found("Insta360", "unknown", 0.30, None))
    )


def log_confirmed(frames: DataFrame, key: str, p1_min: float, sat_max: float, p99_max: float, expected: int = 3) -> DataFrame:
    """key, is_log, confidence from frame statistics (p1, p99, sat): upper medians over the frames; fewer
    frames than expected - 1 (or than one) give no verdict."""
    upper = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))
    m = frames.groupBy(key).agg(F.count("*").alias("n"), upper("p1").alias("p1"), upper("p99").alias("p99"), upper("sat").alias("sat"))
    hit = (F.col("p1") >= p1_min) & (F.col("sat") <= sat_max) & (F.col("p99") <= p99_max)
    m = m.filter(F.col("n") >= max(1, expected - 1))
    return m.select(key, hit.cast("int").alias("is_log"), F.when(hit, 0.75).otherwise(0.8).alias("confidence"))


def qr_class(data: Column) -> Column:
    d = F.lower(F.trim(data))
    return (
        F.when(d.startswith("wxp://") | d.contains("wx.tenpay.com"), "payment_qrcode_wechat")
        .when(d.contains("alipay"), "payment_qrcode_alipay")
        .otherwise("qrcode")
    )


def vision_gate(verdicts: DataFrame, faces: DataFrame, reasons: dict[str, str], least: float, guarded: tuple[str, ...] = ("document", "ecommerce")) -> DataFrame:
    """asset_id, filter_reason of verdicts (asset_id, is_junk, kind, confidence) that hide an asset: junk of
    a known kind with enough confidence; guarded kinds don't hide an asset with faces."""
    reason = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])
    hit = verdicts.filter(F.col("is_junk") & (F.col("confidence") >= least)).withColumn("filter_reason", F.try_element_at(reason, F.col("kind"))).filter("filter_reason is not null")
    seen = faces.select("asset_id").distinct().withColumn("__face", F.lit(True))
    hit = hit.join(seen, "asset_id", "left").filter(~(F.col("kind").isin(*guarded) & F.coalesce("__face", F.lit(False))))
    return hit.select("asset_id", "filter_reason")


def secret_lines(df: DataFrame, key: str, text: str, patterns: dict[str, str], safe: str | None = None) -> DataFrame:
    """key, line_no, kind of each line that a pattern finds, unless the safe pattern finds it too."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    if safe:
        lines = lines.filter(~F.col("line").rlike(safe))
    kinds = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), k) for k, p in patterns.items()]))
    return lines.select(key, "line_no", F.explode(kinds).alias("kind"))


# Evaluation ---------------------------------------------------------------------------------------------
def centroid_similarity(df: DataFrame, key: str, vector: str, label: str, size: int) -> DataFrame:
    """key, label, sim of each row to its class's mean direction without itself; classes of one are left
    out. Sums are per dimension, so nothing but class sums meets."""
    parts = df.select(key, label, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    sums = parts.groupBy(label, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("total"), F.max("n").alias("n"))
    j = df.join(cut(total, "centroids"), label).filter("n > 1")
    rest = F.zip_with("total", F.transform(F.col(vector), lambda x: x.cast("double")), lambda s, x: s - x)
    return j.withColumn("rest", rest).select(key, label, dot(normalised("rest"), normalised(vector)).alias("sim"))


#: Values that `order_statistics` draws to guess where to look, and that it gathers at most to look there.
GUESS, GATHER = 20_000, 50_000
#: Places in a range that a further pass tries.
TRIES = 64
_TOP = (1 << 63) - 1


def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles, NaN last; both zeros are one."""
    bits = (np.asarray(v, dtype=np.float64) + 0.0).view(np.int64)
    return np.where(np.isnan(v), _TOP - 1, bits ^ ((bits >> 63) & _TOP))


def _value(key: int) -> float:
    k = np.int64(key)
    return float("nan") if key >= _TOP - 1 else float((k ^ ((k >> 63) & np.int64(_TOP))).view(np.float64))


def _counts(values: DataFrame, cuts: list[int]) -> list[int]:
    """How many values lie below each ascending cut; a row per task and cut that it has values next to comes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(np.array(cuts), _ordered(b.column(0).to_numpy(zero_copy_only=False)), "right"), minlength=len(cuts) + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = {r["at"]: r["n"] for r in values.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return np.cumsum([got.get(i, 0) for i in range(len(cuts))]).tolist()


def _inside(values: DataFrame, ranges: list[tuple[int, int]]) -> list[int]:
    """The values in some ranges, as ordered numbers, sorted."""
    lo, hi = (np.array([r[i] for r in ranges]) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = _ordered(b.column(0).to_numpy(zero_copy_only=False))
            at = np.searchsorted(lo, k, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(k[(at >= 0) & (k < hi[at])])], names=["k"])

    return sorted(r["k"] for r in values.mapInArrow(run, "k bigint").collect())


def order_statistics(df: DataFrame, column: str, points: list[float]) -> list[float] | None:
    """Exact, linearly interpolated quantiles of a column's values, as many as points; None without values.

    No value moves: a sample of about GUESS values says where each asked place must be, exact counts over all values tell whether it
    is there, and ranges that still hold too many are cut into smaller ones and counted again. In the end the
    few values of the ranges come to the driver, GATHER at most; a range of one value needs none."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = values.count()
    if not n:
        return None
    places = [p * (n - 1) for p in points]
    asked = sorted({x for p in places for x in (math.floor(p), math.ceil(p))})
    drawn = sorted(_ordered(np.array([r["v"] for r in values.sample(min(1.0, GUESS / n), 11).collect()] or [0.0])).tolist())
    m, cuts = len(drawn), {-_TOP, _TOP}
    for r in asked:
        q = r / max(1, n - 1)
        wide = 4 * math.sqrt(q * (1 - q) / m) + 2 / m
        cuts |= {drawn[min(m - 1, max(0, int((q - wide) * m)))], drawn[min(m - 1, max(0, int((q + wide) * m) + 1))]}
    known = {-_TOP: 0, _TOP: n}
    while True:
        new = sorted(cuts - set(known))
        known |= dict(zip(new, _counts(values, new))) if new else {}
        at = sorted(known)
        below = [known[c] for c in at]
        ranges = {}
        for r in asked:
            i = bisect.bisect_right(below, r) - 1  # the last cut with at most r values below it
            ranges[r] = (at[i], at[i + 1])
        todo = sorted({x for x in ranges.values() if x[1] - x[0] > 1})
        if sum(known[b] - known[a] for a, b in todo) <= GATHER:
            break
        cuts = set()
        for a, b in todo:
            if known[b] - known[a] > GATHER // (2 * len(todo)):
                x, y = _value(max(a, -_TOP + 2)), _value(min(b, _TOP - 2))
                cuts |= {a + (b - a) * i // TRIES for i in range(1, TRIES)}
                if math.isfinite(x) and math.isfinite(y):
                    cuts |= {int(k) for k in _ordered(np.linspace(x, y, TRIES + 1)) if a < k < b}
    held = _inside(values, todo) if todo else []
    found = {}
    for r, (a, b) in ranges.items():
        first = bisect.bisect_left(held, a)
        found[r] = _value(a if b - a == 1 else held[first + r - known[a]])
    at = lambda lo, hi, part: lo if not part or lo == hi else lo + (hi - lo) * part
    return [at(found[math.floor(p)], found[math.ceil(p)], p - math.floor(p)) for p in places]


def _above(scores: DataFrame, score: str, same: str, cuts: list[float]) -> list[tuple[int, int]]:
    """For each ascending cut the numbers of rows of the same and of different kinds at or above it. A task
    counts its rows between neighbouring cuts; one row per cut and task comes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(cuts) + 1), dtype=np.int64)
        for b in batches:
            at = np.searchsorted(np.array(cuts), b.column(0).to_numpy(zero_copy_only=False), "right")
            kind = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for k in range(2):
                total[k] += np.bincount(at[kind == (k == 0)], minlength=len(cuts) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1)), pa.array(total[0]), pa.array(total[1])], names=["at", "tp", "fp"])

    rows = scores.filter(F.col(score).isNotNull() & F.col(same).isNotNull()).select(F.col(score).cast("double"), F.col(same).cast("boolean"))
    got = rows.mapInArrow(run, "at bigint, tp bigint, fp bigint").groupBy("at").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).collect()
    tp, fp, out = 0, 0, []
    for r in sorted(got, key=lambda r: -r["at"]):
        tp, fp = tp + r["tp"], fp + r["fp"]
        out.append((tp, fp))
    return out[::-1]  # the first is of all rows


def best_f1(scores: DataFrame, score: str, same: str, thresholds: int = 400) -> DataFrame:
    """threshold, f1, precision, recall that maximise F1 over so many quantiles, from 1 to 99 %, of all
    scores; ties go to the lower threshold. Precision is that of the rates of both kinds, as if there were
    as many pairs of one as of the other."""
    qs = order_statistics(scores.filter(F.col(same).isNotNull()), score, [0.01 + 0.98 * i / (thresholds - 1) for i in range(thresholds)])
    schema = "threshold double, f1 double, precision double, recall double"
    if qs is None:
        return scores.sparkSession.createDataFrame([], schema)
    cuts = sorted(set(qs))
    counts = _above(scores, score, same, cuts)
    best = None
    for t, (tp, fp) in zip(cuts, counts[1:]):
        r, f = (x / n if n else 0.0 for x, n in zip((tp, fp), counts[0]))
        p = r / (r + f) if r + f else 0.0
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        if best is None or f1 > best[1]:
            best = (t, f1, p, r)
    return scores.sparkSession.createDataFrame([best], schema)


def rates_table(scores: DataFrame, score: str, same: str, fprs: list[float] = (), tprs: list[float] = ()) -> DataFrame:
    """kind, rate, threshold, other: for each rate of false matches the threshold that gives it and the rate
    of true ones there; for each rate of true matches the threshold and the rate of false ones. Thresholds
    are exact interpolated quantiles."""
    rows, schema = [], "kind string, rate double, threshold double, other double"
    for kind, rates, of_same in (("fpr", fprs, False), ("tpr", tprs, True)):
        own = scores.filter(F.col(same) == of_same)
        cuts = order_statistics(own, score, [1 - r for r in rates]) if rates else None
        if cuts is None:
            continue
        order = sorted(range(len(rates)), key=lambda i: cuts[i])
        counts = _above(scores, score, same, [cuts[i] for i in order])
        at = 1 if kind == "tpr" else 0
        for place, i in enumerate(order):
            n = counts[0][at]
            rows.append((kind, rates[i], cuts[i], counts[place + 1][at] / n if n else None))
    return scores.sparkSession.createDataFrame(rows, schema)


def tpr_at_fpr(scores: DataFrame, score: str, same: str, rates: list[float]) -> DataFrame:
    """fpr, threshold, tpr."""
    return rates_table(scores, score, same, fprs=rates).select(F.col("rate").alias("fpr"), "threshold", F.col("other").alias("tpr"))


def fpr_at_tpr(scores: DataFrame, score: str, same: str, rates: list[float]) -> DataFrame:
    """tpr, threshold, fpr."""
    return rates_table(scores, score, same, tprs=rates).select(F.col("rate").alias("tpr"), "threshold", F.col("other").alias("fpr"))


def retrieval_margin(scored: DataFrame, least: int = 3) -> DataFrame:
    """query, n, pos_sim, neg_sim, margin of rows (query, sim, relevant): mean similarity of relevant items
    less that of the others, for queries with at least `least` relevant ones."""
    pos, neg = F.when(F.col("relevant"), F.col("sim")), F.when(~F.col("relevant"), F.col("sim"))
    m = scored.groupBy("query").agg(F.count(pos).alias("n"), F.avg(pos).alias("pos_sim"), F.avg(neg).alias("neg_sim")).filter(F.col("n") >= least)
    return m.withColumn("margin", F.col("pos_sim") - F.col("neg_sim"))


def recall_at(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query, recall of ranked rows (query, item, rank) against truth (query, item)."""
    n = truth.groupBy("query").agg(F.count("*").alias("n"))
    hit = ranked.filter(F.col("rank") <= k).join(truth, ["query", "item"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    return n.join(hit, "query", "left").select("query", (F.coalesce("hits", F.lit(0)) / F.least("n", F.lit(k))).alias("recall"))


def quantiles(df: DataFrame, column: str, points: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row of exact, linearly interpolated percentiles p1, p5, ..."""
    got = order_statistics(df, column, list(points)) or [None] * len(points)
    return df.sparkSession.createDataFrame([tuple(got)], ", ".join(f"p{round(p * 100)} double" for p in points))


def _drawn(*parts: Column | str) -> Column:
    """A number of 60 bits from the parts' hash, the same wherever it is computed."""
    text = F.concat_ws("\x1f", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def sample_pairs(df: DataFrame, key: str, label: str, cap: int = 400, least: int = 5, seed: int = 7) -> DataFrame:
    """a, b, same: per class of at least `least` rows, `cap` pairs inside it (all, if it has no more), and as many
    pairs of different classes as these are together.

    A class's rows are numbered in a seeded order. A pair inside it has a number too: the pair (i, j), i < j, is
    j (j - 1) / 2 + i. A class with up to four times cap pairs puts all numbers in the order of their hashes, a larger
    one draws four times cap numbers by hash; the first cap different ones are the sample, so all pairs are
    equally likely and no others are built. A pair of different classes is drawn as two classes and a row of
    each; repeats are drawn past, out of four times as many draws."""
    rows = df.select(F.col(key).alias("k"), F.col(label).alias("l")).filter("l is not null")
    sizes = cut(rows.groupBy("l").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "classes")
    name = F.col("l").cast("string")
    ordered = rows.join(sizes.select("l"), "l", "left_semi").withColumn("h", hash_order(seed, "k"))
    placed = cut(before(ordered, ["l"], [F.col("h"), F.col("k")], "p", total=F.lit(1)).select("l", "k", "p"), "places")
    # Numbers of pairs: (class, number, order).
    total = F.expr("n * (n - 1) div 2")
    asked = sizes.withColumn("pairs", total).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4 * cap - 1).cast("bigint"))))
    small = F.col("pairs") <= 4 * cap
    draw = F.pmod(_drawn(str(seed), "inside", name, F.col("i").cast("string")), F.col("pairs"))
    asked = asked.filter(~small | (F.col("i") < F.col("pairs"))).withColumn("number", F.when(small, F.col("i")).otherwise(draw))
    order = F.when(small, _drawn(str(seed), "order", name, F.col("number").cast("string"))).otherwise(F.col("i"))
    once = asked.withColumn("order", order).groupBy("l", "number").agg(F.min("order").alias("order"))
    chosen = once.withColumn("rn", F.row_number().over(Window.partitionBy("l").orderBy("order", "number"))).filter(F.col("rn") <= cap)
    root = F.floor((1 + F.sqrt(1 + 8 * F.col("number").cast("double"))) / 2).cast("bigint")
    fix = lambda j: F.when(j * (j - 1) / 2 > F.col("number"), j - 1).when((j + 1) * j / 2 <= F.col("number"), j + 1).otherwise(j)
    chosen = chosen.withColumn("j", fix(root)).withColumn("i", F.expr("number - j * (j - 1) div 2"))
    one, two = (placed.select("l", F.col("p").alias(i), F.col("k").alias(c)) for i, c in (("i", "a"), ("j", "b")))
    same = cut(chosen.join(one, ["l", "i"]).join(two, ["l", "j"]).select("a", "b", F.lit(True).alias("same")), "same-pairs")
    # Classes are numbered by value; draws are (class, row) twice.
    classes = cut(positions(sizes, [F.col("l")], "c"), "numbered-classes")
    n, wanted = classes.count(), same.count()
    if n < 2:
        return same
    d = F.col("d").cast("string")
    draws = df.sparkSession.range(4 * wanted).select(F.col("id").alias("d"))
    draws = draws.withColumn("ca", F.pmod(_drawn(str(seed), "first", d), F.lit(n))).withColumn("cb", F.pmod(_drawn(str(seed), "second", d), F.lit(n - 1)))
    draws = draws.withColumn("cb", F.col("cb") + (F.col("cb") >= F.col("ca")).cast("bigint"))
    for s in "ab":
        side = classes.select(F.col("c").alias(f"c{s}"), F.col("l").alias(f"l{s}"), F.col("n").alias(f"n{s}"))
        draws = draws.join(side, f"c{s}").withColumn(f"p{s}", F.pmod(_drawn(str(seed), s, d), F.col(f"n{s}")))
    for s in "ab":
        draws = draws.join(placed.select(F.col("l").alias(f"l{s}"), F.col("p").alias(f"p{s}"), F.col("k").alias(s)), [f"l{s}", f"p{s}"])
    pairs = draws.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    ranked = positions(pairs, [F.col("d")], "at").filter(F.col("at") < wanted)
    return same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same").unionByName(ranked.select("a", "b", F.lit(False).alias("same")))


def median_and_top(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, med, top_quarter: the median and the mean of the largest quarter (of one value at least) per group, by
    places in a sorted window, which spills where a group is large."""
    group = Window.partitionBy(by)
    rows = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    rows = rows.withColumns({"rn": F.row_number().over(group.orderBy(F.col("v").desc())), "n": F.count("*").over(group)})
    middle = F.col("rn").isin(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2))
    top = F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    return rows.groupBy(by).agg(F.avg(F.when(middle, F.col("v"))).alias("med"), F.avg(F.when(top, F.col("v"))).alias("top_quarter"))


def histogram(df: DataFrame, label: str) -> DataFrame:
    """label, n, share."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("t")).alias("share"))


def prediction_errors(df: DataFrame, predicted: str, actual: str, child: float = 16.0) -> DataFrame:
    """n, median and p90 absolute error, share of equal age bins, share of children (below `child`) found."""
    e = df.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).withColumn("err", F.abs(F.col(predicted) - F.col(actual)))
    median, p90 = order_statistics(e, "err", [0.5, 0.9]) or (None, None)
    return e.agg(
        F.count("*").alias("n"), F.lit(median).cast("double").alias("median_error"), F.lit(p90).cast("double").alias("p90_error"),
        F.avg((age_bin(predicted) == age_bin(actual)).cast("double")).alias("bin_hit"),
        F.avg(F.when(F.col(actual) < child, (F.col(predicted) < child).cast("double"))).alias("child_hit"),
    )


# Assignment by nearest neighbours -----------------------------------------------------------------------
#: Least similarity by embedding model, and for other models.
LEAST_BY_MODEL = {"SFace-2021dec": 0.5437, "AdaFace-IR18-WebFace4M": 0.51}
LEAST_OTHERWISE = 0.55
#: What children's matches need more, of similarity and of votes, and the most votes asked.
CHILD_SIM, CHILD_RATIO, MOST_RATIO = 0.07, 0.1, 0.85


def least_similarity(model: str, setting: str | None = None) -> float:
    """A model's threshold, unless a setting's text gives a number."""
    try:
        return float(setting)
    except (TypeError, ValueError):
        return LEAST_BY_MODEL.get(model, LEAST_OTHERWISE)


def usable_references(faces: DataFrame) -> DataFrame:
    """Faces that people confirmed, of usable or small quality: no automatic match may feed another."""
    return faces.filter((F.col("sample_role") == "manual") & F.col("quality_class").isin("usable", "small"))


def assign_people(neighbours: DataFrame, children: DataFrame, least: float, k: int = 10, ratio: float = 0.6) -> DataFrame:
    """query, label, votes, decision of kNN rows (query, ref, label, sim, rank). In order: the nearest one
    isn't valid (below 0): abstain_invalid; it is below `least`, more for a child: abstain_similarity; the
    top label leads by less than two votes: abstain_margin; it has too small a share, children need more:
    abstain_ratio; else assign. Tied labels go to the one with the nearest neighbour. children: (label)."""
    kids = children.select("label").distinct().withColumn("child", F.lit(True))
    first = neighbours.filter("rank = 1").join(kids, "label", "left").select("query", F.col("sim").alias("top_sim"), F.coalesce("child", F.lit(False)).alias("top_child"))
    votes = neighbours.groupBy("query", "label").agg(F.count("*").alias("votes"), F.min("rank").alias("nearest"))
    w = Window.partitionBy("query").orderBy(F.col("votes").desc(), "nearest")
    best = votes.withColumns({"rn": F.row_number().over(w), "second": F.coalesce(F.lead("votes").over(w), F.lit(-2)), "n": F.sum("votes").over(Window.partitionBy("query"))})
    best = best.filter("rn = 1").join(kids, "label", "left").join(first, "query")
    need = F.lit(least) + F.when(F.col("top_child"), CHILD_SIM).otherwise(0.0)
    share = F.least(F.lit(MOST_RATIO), F.lit(ratio) + F.when(F.coalesce("child", F.lit(False)), CHILD_RATIO).otherwise(0.0))
    decision = (
        F.when(F.col("top_sim") < 0, "abstain_invalid").when(F.col("top_sim") < need, "abstain_similarity")
        .when(F.col("votes") - F.col("second") < 2, "abstain_margin")
        .when(F.col("votes") / F.least(F.lit(k), F.col("n")) < share, "abstain_ratio").otherwise("assign")
    )
    return best.select("query", "label", "votes", decision.alias("decision"))


def screenshot_suspect(width: Column, height: Column, edge_spreads: Column, top_spread: Column) -> Column:
    """An image's shape of a full screen, no edge with texture (spreads of the four edges up to 12) and an
    even top (below 18), from statistics that an adapter gives. Null statistics give false."""
    shape = F.greatest(width, height) / F.least(width, height) >= 1.9
    return F.coalesce(shape & (F.array_max(edge_spreads) <= 12) & (top_spread < 18), F.lit(False))
