"""Column expressions: vectors, bits, sets, boxes, dates, text, scores. All stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Vectors ------------------------------------------------------------------------------------------------
def dot(a, b) -> Column:
    """Dot product in double precision, terms added in order."""
    terms = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def floats(blob, dimension: int | None = None) -> Column:
    """A vector from its little-endian 32-bit floats; null for a length that isn't 4 bytes each (or the
    dimension's), and for values that aren't finite. Decoded in Arrow batches."""

    @F.pandas_udf("array<float>")
    def decode(column: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(x) % 4 or (dimension is not None and len(x) != 4 * dimension):
                return None
            v = np.frombuffer(x, dtype="<f4")
            return v if np.isfinite(v).all() else None

        return column.map(one)

    return decode(_c(blob))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null where either vector is null or shorter than 1e-6."""
    n = norm(a) * norm(b)
    return F.when((norm(a) > 1e-6) & (norm(b) > 1e-6), dot(a, b) / n)


def normalised(a) -> Column:
    """The vector at length 1; null for one shorter than 1e-6. Its length is the one element of an outer array, as an
    expression inside an inner function is evaluated anew for each element."""
    scaled = lambda n: F.when(n > 1e-6, F.transform(_c(a), lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))


def sign_bits(a, bits: int) -> Column:
    """A signed 64-bit code with bit i set where element i is positive."""
    parts = [F.when(F.get(_c(a), F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(bits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


# Bits ---------------------------------------------------------------------------------------------------
def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def signed64(text) -> Column:
    """An unsigned 64-bit number, given as decimal text, in signed storage."""
    x = _c(text).cast("decimal(20,0)")
    return F.when(x >= F.lit("9223372036854775808").cast("decimal(20,0)"), x - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x).cast("bigint")


# Sets and boxes -----------------------------------------------------------------------------------------
def jaccard(a, b) -> Column:
    """0 where either set is null or empty."""
    u = F.size(F.array_union(_c(a), _c(b)))
    some = (F.size(F.coalesce(_c(a), F.array())) > 0) & (F.size(F.coalesce(_c(b), F.array())) > 0)
    return F.when(some, F.size(F.array_intersect(_c(a), _c(b))) / u).otherwise(F.lit(0.0))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of (x, y, w, h) boxes; 0 where the union is empty."""
    ax, ay, aw, ah = map(_c, a)
    bx, by, bw, bh = map(_c, b)
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def mmr_similarity(day_a, day_b, tags_a, tags_b) -> Column:
    """0.5 for the same day (two missing days are the same) plus half the tags' Jaccard similarity."""
    return F.when(_c(day_a).eqNullSafe(_c(day_b)), F.lit(0.5)).otherwise(F.lit(0.0)) + 0.5 * jaccard(tags_a, tags_b)


# Dates --------------------------------------------------------------------------------------------------
def day_text(c) -> Column:
    return F.substring(_c(c), 1, 10)


def epoch_seconds(text) -> Column:
    """Seconds since 1970 of an ISO text; without an offset it is taken as +08:00; bad text is null."""
    t = F.trim(_c(text))
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.unix_timestamp(F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.lit("+08:00")))))


def age_years(born, at) -> Column:
    return F.datediff(_c(at), _c(born)) / 365.25


def age_parts(born, at) -> Column:
    """Full years and months."""
    m = F.floor(F.months_between(_c(at), _c(born))).cast("int")
    return F.struct(F.floor(m / 12).cast("int").alias("years"), F.pmod(m, F.lit(12)).alias("months"))


def weekday_name(c, names=("周一", "周二", "周三", "周四", "周五", "周六", "周日")) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.weekday(_c(c)))


def is_night(ts, first_hour: int = 8, last_hour: int = 23, zone: str = "+08:00") -> Column:
    h = F.hour(F.from_utc_timestamp(_c(ts), zone))
    return ~((h >= first_hour) & (h < last_hour))


# Text ---------------------------------------------------------------------------------------------------
def rewrite_prefix(c, old: str, new: str) -> Column:
    """new in place of old where the text starts with it, as it stands; else unchanged."""
    return F.when(F.startswith(_c(c), F.lit(old)), F.concat(F.lit(new), F.substring(_c(c), F.lit(len(old) + 1), F.length(_c(c))))).otherwise(_c(c))


def last_folder(path) -> Column:
    """The last non-empty folder above a path's file; null without one."""
    parts = F.split(_c(path), "/")
    folders = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
    return F.try_element_at(folders, F.lit(-1))


def stable_id(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(_c(c), 256), 1, 24))


def serial_id(prefix: str, n, digits: int = 7) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", _c(n).cast("bigint"))


def json_text(*columns) -> Column:
    """The columns as one JSON object, without spaces; nulls are written as such."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def json_payload(text) -> Column:
    """The first object or array in a model's answer: fences and trailing commas go."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"```(?:json)?", "")
    got = F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.nullif(F.regexp_replace(got, r",\s*([}\]])", "$1"), F.lit(""))


def like(c, pattern: str) -> Column:
    """LIKE that takes A-Z for a-z and no other letters for each other."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(_c(c), upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


def shortened(c, most: int) -> Column:
    """Trimmed and cut to so many characters; null counts as empty."""
    return F.substring(F.trim(F.coalesce(_c(c), F.lit(""))), 1, most)


def known_first(values, vocabulary: list[str], most: int) -> Column:
    """The first few values that a vocabulary has, in the values' order, each once."""
    return F.slice(F.array_distinct(F.filter(_c(values), lambda x: x.isin(*vocabulary))), 1, most)


def linear_head(vector, weights: list[float], bias: float, digits: int = 3) -> Column:
    """A score of a vector: its product with the weights, plus the bias."""
    return F.round(dot(vector, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias)), digits)


def text_regions(regions, least: float = 0.55, most: int = 600) -> Column:
    """n_regions, mean_conf (3 decimals) and text of recognised regions (text, confidence): blank ones and
    those below the least confidence don't count, the text is cut to its most characters."""
    clean = F.transform(F.coalesce(_c(regions), F.array().cast("array<struct<text:string,confidence:double>>")), lambda r: F.struct(F.trim(r["text"]).alias("text"), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence")))
    kept = F.filter(clean, lambda r: (r["text"] != "") & (r["confidence"] >= least))
    n = F.size(kept)
    total = F.aggregate(kept, F.lit(0.0), lambda s, r: s + r["confidence"].cast("double"))
    mean = F.when(n > 0, round_even(total / n, 3)).otherwise(F.lit(0.0))
    return F.struct(n.alias("n_regions"), mean.alias("mean_conf"), F.substring(F.array_join(F.transform(kept, lambda r: r["text"]), " "), 1, most).alias("text"))


def number_or(c, kind: str, otherwise) -> Column:
    """The text as a number, or another value where it isn't one."""
    return F.coalesce(_c(c).try_cast(kind), F.lit(otherwise).cast(kind))


def is_date(c) -> Column:
    """Whether a text starts like a date."""
    return F.coalesce(_c(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))


# Labels and scores --------------------------------------------------------------------------------------
def round_even(c, digits: int) -> Column:
    """Half to even, as Python rounds."""
    return F.bround(_c(c), digits)


# The thresholds and labels of the next three functions, the penalties of `combined_quality` and the terms
# of `asset_score`.
def blur_label(score, blurry: float = 300.0, soft: float = 1200.0) -> Column:
    return F.when(_c(score) < blurry, "blurry").when(_c(score) < soft, "soft").otherwise("sharp")


def age_bin(age) -> Column:
    return F.when(_c(age) < 12, "child").when(_c(age) < 18, "teen").when(_c(age) < 60, "adult").otherwise("elder")


def face_quality(width, height, blur, pose) -> Column:
    return (
        F.when(F.least(_c(width), _c(height)) < 40, "small")
        .when(_c(blur) < 25, "blurry")
        .when(_c(pose) > 0.38, "nonfrontal_candidate")
        .otherwise("usable")
    )


def combined_quality(aesthetic, label) -> Column:
    """Fixed penalties: the aesthetic score with a penalty by blur label, 3 decimals; an unknown label has none. A penalty
    raises a negative score, which is kept as it is known."""
    factor = F.when(_c(label) == "blurry", 0.5).when(_c(label) == "soft", 0.85).otherwise(1.0)
    return round_even(_c(aesthetic) * factor, 3)


def evidence_kind(reason) -> Column:
    """By the reason's ending; path for any other, as a check of the evidence table allows no further kind."""
    return F.when(F.endswith(_c(reason), F.lit("_FILENAME")), "filename").otherwise("path")


def mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(_c(lat)) / 2))


def asset_score(label, aesthetic, mean, spread, width, height, has_face) -> Column:
    """Fixed terms: sharpness term + 2 tanh of the standardised aesthetic + 0.4 ln(area + 1) + 1.5 with a face; 4
    decimals. A missing label counts as sharp, a missing aesthetic as none."""
    blur = F.when(_c(label) == "blurry", -6.0).when(_c(label) == "soft", 0.0).when(_c(label).isNull() | (_c(label) == "sharp"), 2.0).otherwise(0.0)
    z = F.when(_c(aesthetic).isNotNull() & (_c(spread) > 1e-6), 2.0 * F.tanh((_c(aesthetic) - _c(mean)) / (2.0 * _c(spread)))).otherwise(0.0)
    area = F.greatest(F.coalesce(_c(width), F.lit(0)) * F.coalesce(_c(height), F.lit(0)), F.lit(1))
    return round_even(blur + z + F.log(area + 1) * 0.4 + F.when(F.coalesce(_c(has_face), F.lit(False)), 1.5).otherwise(0.0), 4)


def crop_window(width, height, cx, cy) -> Column:
    """The largest 4:3 window centred near a point, inside the image."""
    w = F.least(_c(width).cast("double"), _c(height) * 4.0 / 3.0)
    h = w * 3.0 / 4.0
    return _window(_c(width), _c(height), _c(cx) - w / 2, _c(cy) - h / 2, w, h)


def _within(x: Column, most: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, most))


def _window(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(_within(x, width - w).alias("x"), _within(y, height - h).alias("y"), w.alias("w"), h.alias("h"))


def smart_crop(width, height, faces, subject, horizon) -> Column:
    """method, x, y, w, h (shares of the image, 4 decimals) of the first strategy that applies: around the
    faces (array of x, y, w, h in pixels), a salient subject (struct cx, cy), the horizon (its row), or the
    centre. Faces too tall for a 4:3 window get a 3:4 one; a window that cuts the topmost face moves up. A
    horizon in the upper half shows more of what is below it, else it comes to the window's lower third."""
    W, H = _c(width).cast("double"), _c(height).cast("double")
    f = _c(faces)
    edge = lambda how, at: how(F.transform(f, at))
    x1, y1 = F.greatest(F.lit(0.0), edge(F.array_min, lambda b: b["x"])), F.greatest(F.lit(0.0), edge(F.array_min, lambda b: b["y"]))
    x2, y2 = F.least(W, edge(F.array_max, lambda b: b["x"] + b["w"])), F.least(H, edge(F.array_max, lambda b: b["y"] + b["h"]))
    tall, cx = y2 - y1, (x1 + x2) / 2
    top = y1 - tall * 0.2
    upright_h = F.least(H, W * 4.0 / 3.0)
    upright_w = upright_h * 3.0 / 4.0
    upright = _window(W, H, cx - upright_w / 2, F.when(upright_h >= tall, top).otherwise((y1 + y2) / 2 - upright_h / 2), upright_w, upright_h)
    flat_w = F.least(W, H * 4.0 / 3.0)
    flat_h = flat_w * 3.0 / 4.0
    placed = _within((y1 + y2) / 2 - tall * 0.12 - flat_h / 2, H - flat_h)
    flat = _window(W, H, cx - flat_w / 2, F.when(placed > top, top).otherwise(placed), flat_w, flat_h)
    line = _c(horizon).cast("double")
    level = F.when(line / H < 0.5, F.least(line + (H - line) * 0.5, H - H * 3 / 8)).otherwise(F.greatest(line - H * 3 / 16, H * 3 / 8))
    ways = [
        ("face", F.size(F.coalesce(f, F.array())) > 0, F.when(tall * 4.0 / 3.0 > W, upright).otherwise(flat)),
        ("saliency", _c(subject).isNotNull(), crop_window(W, H, _c(subject)["cx"], _c(subject)["cy"])),
        ("horizon", line.isNotNull(), crop_window(W, H, W / 2, level)),
        ("center", F.lit(True), crop_window(W, H, W / 2, H / 2)),
    ]
    out = None
    for name, applies, r in reversed(ways):
        r = F.struct(F.lit(name).alias("method"), *[round_even(r[k] / size, 4).alias(k) for k, size in (("x", W), ("y", H), ("w", W), ("h", H))])
        out = r if out is None else F.when(applies, r).otherwise(out)
    return out


#: Eyes are open above this height over width, a smile above this width over eye distance; places
#: of the right eye, the left eye and the mouth's corners among 106 landmarks.
EYES_OPEN, SMILING = 0.28, 0.72
RIGHT_EYE, LEFT_EYE, MOUTH = (33, 43), (88, 96), (52, 58)


def point_metrics(points, open_at: float = EYES_OPEN, smile_at: float = SMILING) -> Column:
    """Eye and mouth measures of 106 landmarks (array of struct x, y); null where they can't be a face's."""

    def spread(a: int, b: int, axis: str) -> Column:
        part = F.transform(F.slice(_c(points), a + 1, b - a), lambda p: p[axis])
        return F.array_max(part) - F.array_min(part)

    def mean(a: int, b: int, axis: str) -> Column:
        part = F.transform(F.slice(_c(points), a + 1, b - a), lambda p: p[axis])
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / (b - a)

    def ratio(a: int, b: int) -> Column:
        return F.when(spread(a, b, "x") >= 1, round_even(spread(a, b, "y") / spread(a, b, "x"), 3))

    right, left = ratio(*RIGHT_EYE), ratio(*LEFT_EYE)
    eyes = F.sqrt(F.pow(mean(*RIGHT_EYE, "x") - mean(*LEFT_EYE, "x"), 2) + F.pow(mean(*RIGHT_EYE, "y") - mean(*LEFT_EYE, "y"), 2)) + 1e-6
    p, q = F.get(_c(points), F.lit(MOUTH[0])), F.get(_c(points), F.lit(MOUTH[1]))
    smile = round_even(F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)) / eyes, 3)
    return F.when(
        (right <= 1) & (left <= 1) & (smile <= 1.1),
        F.struct(
            right.alias("eye_ratio_r"), left.alias("eye_ratio_l"), ((right + left) / 2 > open_at).alias("eyes_open"),
            round_even((right + left) / 2, 3).alias("eye_open_score"), smile.alias("smile_ratio"), (smile > smile_at).alias("is_smiling"),
        ),
    )
