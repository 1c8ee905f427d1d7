"""Scalar text functions as Spark column expressions (JVM side, codegen-able).

Every function takes and returns ``Column``; none of them runs Python per row.
ANSI mode is on in Spark 4, so casts use ``try_cast`` and divisions ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penawar.config import DEFAULT, MatchConfig

# Fixed value: the characters JavaScript's String.prototype.trim removes
# (tab, line feed, vertical tab, form feed, carriage return, space, no-break space,
# U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000, U+FEFF).
JS_BLANK_CHARS = ("\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(s) -> Column:
    """T1 trim: strip the JavaScript blank characters at both ends (``btrim``
    with an explicit character set: no regular expression per row)."""
    return F.btrim(_c(s), F.lit(JS_BLANK_CHARS))


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the costly column ``name`` computed once a row: the optimizer moves no filter through an explode, so
    later filters read the column instead of repeating its expression (several times, where it names itself often)."""
    return df.withColumn(name, F.explode(F.array(name)))


def normalise_key(s) -> Column:
    """Cache key of an order line = trimmed, lower-cased text."""
    return F.lower(js_trim(s))


def words(s) -> Column:
    """Maximal runs of letters/digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(s)), F.lit("[\\p{L}\\p{N}]+"), 0)


def trigram_array(s) -> Column:
    """Trigrams of every word, padded with two blanks before, one after;
    in word order, duplicates kept (the ordered sequence word_similarity scans)."""
    return F.flatten(
        F.transform(
            words(s),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) + 1),
                lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3),
            ),
        )
    )


def trigram_set(s) -> Column:
    return F.array_sort(F.array_distinct(trigram_array(s)))


def js_number(s) -> Column:
    """What JavaScript's Number() reads from a text, or null (NaN): blank is 0; decimals, exponents, 0x hex and
    Infinity; nothing else, so no literal suffixes such as ``5d``."""
    t = js_trim(_c(s).cast("string"))
    inf = F.lit(float("inf"))
    return (F.when(t == "", F.lit(0.0))
            .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
            .when(t.rlike(r"^[+-]?Infinity$"), F.when(t.startswith("-"), -inf).otherwise(inf))
            .when(t.rlike(r"^0[xX][0-9a-fA-F]+$"), F.conv(t.substr(F.lit(3), F.length(t)), 16, 10).cast("double")))


def _try_double(s: Column) -> Column:
    return F.when(s == "", F.lit(None).cast("double")).otherwise(s.try_cast("double"))


def parse_price(s) -> Column:
    """Indonesian price text to number; anything unreadable is 0.

    Strip every ``Rp`` (any case) and trim; with a comma drop all dots and turn
    the first comma into the decimal point, else just drop the dots; then read
    the leading number.
    """
    t = js_trim(F.regexp_replace(_c(s).cast("string"), "(?i)rp", ""))
    body = F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    # the pattern lets no text through that reads as NaN; an empty one reads as null
    num = F.regexp_extract(body, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double")
    return F.coalesce(num, F.lit(0.0))


def json_in_text(s) -> Column:
    """The first JSON value inside model text, as text (null if none).

    A ```json fence first, else any fence, else the whole text; trimmed. The
    earlier of ``[`` and ``{`` decides the kind; cut to the last closer.
    Without any bracket the whole text is returned (it may still parse).
    """
    return json_cut(unfenced(s))


def unfenced(s) -> Column:
    """First half of T8: the trimmed text inside the fence, if there is one. A caller that keeps it in a column of its own
    has the patterns run once a row; ``json_cut`` names its text often."""
    s = _c(s)
    # fixed values: the code fences that models write
    fenced_json = F.regexp_extract(s, r"```json\s*([\s\S]*?)```", 1)
    has_json = F.regexp_like(s, F.lit(r"```json\s*[\s\S]*?```"))
    fenced_any = F.regexp_extract(s, r"```\s*([\s\S]*?)```", 1)
    has_any = F.regexp_like(s, F.lit(r"```\s*[\s\S]*?```"))
    return js_trim(F.when(~F.contains(s, F.lit("```")), s).when(has_json, fenced_json).when(has_any, fenced_any).otherwise(s))


def json_cut(text) -> Column:
    """Second half of T8: from the first bracket to the last that closes its kind."""
    text = _c(text)
    obj_at = F.instr(text, "{")
    arr_at = F.instr(text, "[")
    n = F.length(text)
    # what follows the last closer; the whole text without one
    last_obj = n - F.length(F.substring_index(text, "}", -1))
    last_arr = n - F.length(F.substring_index(text, "]", -1))
    arr_first = (arr_at > 0) & ((obj_at == 0) | (arr_at < obj_at))
    # slice(start, last+1) in JavaScript is empty when last is before start
    cut_arr = F.when(last_arr >= arr_at, text.substr(arr_at, last_arr - arr_at + 1)).otherwise(F.lit(""))
    cut_obj = F.when(last_obj >= obj_at, text.substr(obj_at, last_obj - obj_at + 1)).otherwise(F.lit(""))
    return F.when(arr_first, cut_arr).when(obj_at > 0, cut_obj).otherwise(text)


def json_parses(s) -> Column:
    """True when the text is valid JSON (failure detection for T8 callers)."""
    return F.try_parse_json(_c(s)).isNotNull()


def clamp_confidence(x) -> Column:
    """Clamp to [0, 1]; not a number -> 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(js_number(x), F.lit(0.0))))


def qty_default(x) -> Column:
    """Quantity that is not a number or 0 becomes 1."""
    v = js_number(x)
    return F.coalesce(F.when(v != 0, v), F.lit(1.0))


def unit_default(x, cfg: MatchConfig = DEFAULT) -> Column:
    """Empty unit becomes ``pcs``."""
    return F.coalesce(F.when(_c(x) != "", _c(x)), F.lit(cfg.default_unit))


def name_default(x, raw) -> Column:
    """Empty name becomes the raw line."""
    return F.coalesce(F.when(_c(x) != "", _c(x)), _c(raw))


def edited_number(s) -> Column:
    """A number typed into a cell: keep digits . , - ; first comma -> dot;
    unreadable -> 0 (so ``1.500.000`` is 0 and ``12,5`` is 12.5)."""
    t = F.regexp_replace(_c(s).cast("string"), r"[^\d.,-]", "")
    t = F.regexp_replace(t, "^([^,]*),", "$1.")
    return F.coalesce(js_number(t), F.lit(0.0))


def format_rupiah(x, null_text: str = "-", decimals: int = 3) -> Column:
    """``Rp 1.234.567,4`` with Indonesian grouping and at most ``decimals`` decimals (the screen shows three, the
    sheet none), null -> dash."""
    v = F.round(_c(x).cast("double"), decimals)
    pattern = "#,##0" + ("." + "#" * decimals if decimals else "")
    grouped = F.translate(F.call_function("format_number", F.abs(v), F.lit(pattern)), ",.", ".,")
    signed = F.when(v < 0, F.concat(F.lit("-"), grouped)).otherwise(grouped)
    return F.when(_c(x).isNull(), F.lit(null_text)).otherwise(F.concat(F.lit("Rp "), signed))


def status_label(src, cfg: MatchConfig = DEFAULT) -> tuple[Column, Column]:
    """(label, tone) of a result source; unknown sources pass through as ``bad``."""
    pairs_label = []
    pairs_tone = []
    for s, label, tone in cfg.status_labels:
        pairs_label += [F.lit(s), F.lit(label)]
        pairs_tone += [F.lit(s), F.lit(tone)]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs_label), _c(src)), _c(src))
    tone = F.coalesce(F.try_element_at(F.create_map(*pairs_tone), _c(src)), F.lit("bad"))
    return label, tone


def cosine(a, b) -> Column:
    """T4: cosine of two float arrays, in double precision; null for a zero vector."""
    a, b = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.try_divide(dot, norm(a) * norm(b))


def number_text(c: Column) -> Column:
    """A double as JavaScript writes it: whole numbers without fraction or exponent, others with all their digits.
    Outside 1e-6 .. 1e21 the exponent form of Spark stays."""
    v = c.cast("double")
    plain = F.regexp_replace(v.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    whole = v.cast("decimal(38,0)").cast("string")
    return F.when(v == F.round(v, 0), F.when(F.abs(v) < 1e21, whole).otherwise(v.cast("string"))) \
        .when((F.abs(v) >= 1e-6) & (F.abs(v) < 1e21), plain).otherwise(v.cast("string"))


def vector_literal(v) -> Column:
    """``[a,b,...]`` text of a float array."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(v), lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector_literal(s) -> Column:
    return F.from_json(_c(s), "array<float>")


def embedding_text(name, brand, category) -> Column:
    """Non-empty of name, brand, category joined with `` | ``."""
    parts = [F.when(_c(x) != "", _c(x)) for x in (name, brand, category)]
    return F.concat_ws(" | ", *parts)
