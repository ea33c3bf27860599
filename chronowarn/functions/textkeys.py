"""Text identities, templates and spans as columns."""

from pyspark.sql import Column, DataFrame, functions as F

# Slot pattern for numbers, Chinese numerals and the units they precede.
NUMBER_SLOT = r"\d+(?:[.:：点]\d+)*"
# The range around the numerals (their least and greatest code point) spares other characters the search among them.
NUMERAL_SLOT = r"[\x{3007}-\x{96f6}&&[零〇一二两三四五六七八九十百千万]]+(?=小时|分钟|点|毫升|毫克|次|人|杯|口|千卡)"
CJK = r"[\x{3400}-\x{9fff}]"
MAX_TEXT = 10000


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def text_identity(text) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(_col(text), r"[^\p{L}\p{N}_]+", ""))


def template_identity(text) -> Column:
    """Text identity with number slots collapsed to one mark."""
    return F.lower(F.regexp_replace(_slotted(text), r"[^\p{L}\p{N}_#]+", ""))


def _slotted(text) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), NUMBER_SLOT, "#"), NUMERAL_SLOT, "#")


def template_parts(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without ``text``, with the template identity of the whole text, its first line and its last one.

    A slot never spans lines, so the patterns run once over the text with its line ends kept.  Lower case comes
    last, since it depends on neighbouring letters.
    """
    kept = [c for c in rows.columns if c != text]
    bare = rows.select(*kept, F.regexp_replace(_slotted(text), r"[^\p{L}\p{N}_#\n]+", "").alias("__bare"))
    lines = F.split("__bare", "\n")
    return bare.select(*kept, F.lower(F.replace("__bare", F.lit("\n"), F.lit(""))).alias("whole"), F.lower(F.get(lines, F.lit(0))).alias("head"), F.lower(F.element_at(lines, -1)).alias("tail"))


def content_key(text) -> Column:
    """Digest of the text without white space."""
    return F.sha2(F.regexp_replace(_col(text), r"\s+", ""), 256)


def input_problem(category, text, categories: dict[str, str]) -> Column:
    """Why a text cannot be scored, or NULL.  ``categories`` maps accepted names to canonical ones."""
    known = _col(category).isin(*categories)
    trimmed = F.trim(_col(text))
    return (F.when(~F.coalesce(known, F.lit(False)), "unknown_category").when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, "empty_text")
            .when(F.length(trimmed) > MAX_TEXT, "too_long").when(~trimmed.rlike(CJK), "not_chinese"))


def canonical_category(category, categories: dict[str, str]) -> Column:
    pairs = [F.lit(v) for kv in categories.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.trim(_col(category)))


def canonical_json(*columns: str) -> Column:
    """JSON text with fields in name order and NULLs kept, the form that gets hashed."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def evidence_target(state, score) -> Column:
    """1 for supported or explicitly absent, 0 for insufficient evidence, NULL when undecided."""
    s = _col(state)
    return (F.when(s.isin("supported", "supported_unscored", "explicit_absence"), 1).when(s == "insufficient_evidence", 0)
            .when(s.isin("unreviewed", "disputed"), None).when(_col(score).isNotNull(), 1))


def label_problem(state, score, absent_scale) -> Column:
    """Contradiction between a label state and its score, or NULL."""
    s, v = _col(state), _col(score)
    scored = s.isin("supported", "explicit_absence")
    return (F.when(~s.isin("supported", "supported_unscored", "explicit_absence", "insufficient_evidence", "unreviewed", "disputed"), "unknown_state")
            .when(scored & ~F.coalesce(v.between(0, 100), F.lit(False)), "score_required").when(~scored & v.isNotNull(), "score_not_allowed")
            .when((s == "explicit_absence") & ((v != 0) | ~_col(absent_scale)), "absence_needs_zero"))


def score_band(value) -> Column:
    return F.least(F.floor(_col(value) / 20), F.lit(4)).cast("int")


def apply_curve(value, knots_x: Column, knots_y: Column, strength: float) -> Column:
    """(1 - s) x + s f(x) for a monotone piecewise-linear f with clamped ends."""
    x = _col(value)
    n = F.size(knots_x)
    below = F.size(F.filter(knots_x, lambda k: k <= x))
    i = F.least(F.greatest(below - 1, F.lit(0)), n - 2)
    x0, x1, y0, y1 = F.get(knots_x, i), F.get(knots_x, i + 1), F.get(knots_y, i), F.get(knots_y, i + 1)
    inside = y0 + (y1 - y0) * F.try_divide(x - x0, x1 - x0)
    f = F.when(x <= F.get(knots_x, F.lit(0)), F.get(knots_y, F.lit(0))).when(x >= F.get(knots_x, n - 1), F.get(knots_y, n - 1)).otherwise(inside)
    return x * (1 - strength) + f * strength


def span_problem(text, start, end, quote) -> Column:
    """A quoted span must equal the text at its offsets."""
    t = _col(text)
    got = F.substring(t, _col(start) + 1, _col(end) - _col(start))
    return F.when((_col(start) < 0) | (_col(end) <= _col(start)) | (_col(end) > F.length(t)), "offsets_out_of_text").when(got != _col(quote), "quote_differs")


def token_targets(offsets: Column, spans: Column) -> Column:
    """1 for tokens lying wholly inside any span."""
    inside = lambda o: F.exists(spans, lambda s: (o["start"] >= s["start"]) & (o["end"] <= s["end"]) & (o["end"] > o["start"]))
    return F.transform(offsets, lambda o: F.when(inside(o), 1).otherwise(0))
