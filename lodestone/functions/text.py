"""Text normalisation as Column expressions: accents, keys, property types, names, labels, similarities."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Generic words of accommodation names, names that stand for a missing one, and type markers, longest first.
STOPWORDS = (
    "khach", "san", "khachsan", "hotel", "hotels", "khu", "nghi", "duong", "resort", "resorts", "spa", "the", "and", "&", "villa", "villas", "homestay", "guesthouse", "house", "inn", "motel", "boutique",
)
PLACEHOLDERS = ("khong ten", "khong te", "an danh", "no name", "noname", "anonymous", "unknown", "guest", "khach", "user", "n a", "na", "nan", "none", "null", "", "-", "--")
TYPE_MARKERS = (
    ("khu nghi duong", "resort"), ("guest house", "guesthouse"), ("nha nghi", "guesthouse"), ("khach san", "hotel"), ("biet thu", "villa"), ("can ho", "apartment"),
    ("aparthotel", "apartment"), ("apartment", "apartment"), ("condotel", "apartment"), ("guesthouse", "guesthouse"), ("homestay", "homestay"), ("hostel", "hostel"),
    ("resort", "resort"), ("villas", "villa"), ("villa", "villa"), ("motel", "motel"), ("hotel", "hotel"),
)
UNSPECIFIED = "unspecified"


def _stripped(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).replace("đ", "d").replace("Đ", "D")


def _letters() -> tuple[str, str]:
    """Precomposed Latin letters and what is left of each without its marks, where that is one other character."""
    found = [(c, _stripped(c)) for block in ((0xC0, 0x180), (0x1A0, 0x1B1), (0x1E00, 0x1F00)) for c in map(chr, range(*block))]
    kept = [(c, s) for c, s in found if len(s) == 1 and s != c]
    return "".join(c for c, _ in kept), "".join(s for _, s in kept)


_FROM, _TO = _letters()


def strip_accents(text: Column) -> Column:
    """Letters without diacritics, in the JVM; null gives the empty string.

    Compatibility characters (ligatures, full width) stay; strip_accents_exact takes those apart too.
    """
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), r"\p{M}", "")


@F.pandas_udf(StringType())
def strip_accents_exact(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for text beyond Latin letters."""
    return text.map(lambda x: _stripped(x) if isinstance(x, str) else "")


def folded(text: Column) -> Column:
    """Without accents, lower case, everything but a-z, 0-9 and white space as a blank, blanks joined and trimmed."""
    plain = F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def _joined(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def content_tokens(name: Column) -> Column:
    """Words of a name but the generic ones, in order."""
    return F.filter(_words(folded(name)), lambda t: ~t.isin(*STOPWORDS))


def canonical_key(name: Column) -> Column:
    """Order-free key: distinct content words, sorted."""
    return _joined(content_tokens(name))


def canonical_location(place: Column) -> Column:
    """Without accents, lower case, white space joined."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(place)), r"\s+", " "))


def discriminative_key(name: Column, city: Column) -> Column:
    """The canonical key without the city's words; with them, if nothing else is left."""
    tokens = content_tokens(name)
    rest = F.array_except(tokens, _words(canonical_location(city)))
    return F.when(F.size(rest) > 0, _joined(rest)).otherwise(_joined(tokens))


def property_type(name: Column) -> Column:
    """The one accommodation type that a name states in whole words, else unspecified."""
    text = folded(name)
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(rf"\b{marker}\b")), F.lit(label)) for marker, label in TYPE_MARKERS])))
    return F.when(F.size(found) == 1, found[0]).otherwise(UNSPECIFIED)


def is_placeholder(name: Column, compat: bool = False) -> Column:
    """Whether a display name stands for a missing one.

    A name without any Latin letter or digit folds to the empty string: with
    compat it counts as a placeholder, else only if it has no letter at all.
    """
    key = folded(name)
    hit = key.isin(*PLACEHOLDERS)
    if compat:
        return hit
    return hit & ~((key == "") & F.rlike(F.coalesce(name, F.lit("")), F.lit(r"[\p{L}\p{N}]")))


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def repaired_number(text: Column) -> Column:
    """A double from text with doubled points; null where it is none."""
    return F.replace(F.trim(text), F.lit(".."), F.lit(".")).try_cast("double")


def parsed_date(text: Column, *formats: str) -> Column:
    """A date from ISO text, or from the first of further formats that fits; null else."""
    out = text.try_cast("date")
    for f in formats:
        out = F.coalesce(out, F.try_to_timestamp(text, F.lit(f)).cast("date"))
    return out


def name_words(name: Column) -> Column:
    return F.filter(F.split(F.trim(name), r"\s+"), lambda t: t != "")


def is_initials(name: Column) -> Column:
    """A surname followed by initials only."""
    return F.rlike(F.trim(name), F.lit(r"^[^\s]+(\s+[A-ZĐ]\.)+$"))


def text_tokens(text: Column, accented: str = "à-ỹđ") -> Column:
    """Lower-case words of letters (Vietnamese ones too) and digits, longer than one character."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^a-z0-9{accented}\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) > 1)


def name_token_set(name: Column) -> Column:
    """Distinct words of letters and digits without accents; generic words stay."""
    plain = F.regexp_replace(F.lower(strip_accents(name)), r"[^\p{L}\p{N}]+", " ")
    return F.array_distinct(_words(plain))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets, to 4 decimals; null where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 4))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, to 4 decimals; not symmetric, so keep the order of a and b."""
    return pd.Series([round(difflib.SequenceMatcher(None, x or "", y or "").ratio(), 4) for x, y in zip(a, b, strict=True)])


def label_of(value: Column) -> Column:
    """0 or 1 from yes/no words and numbers, null where blank or neither."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    return F.when(text.isin("yes", "y", "same", "true"), 1).when(text.isin("no", "n", "different", "false"), 0).when(number.isin(0.0, 1.0), number.cast("int"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def json_object(text: Column, schema: str) -> Column:
    """The JSON object within prose or a fenced block, as a struct; null fields where it does not parse."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean to 4 decimals; null where either is null or 0."""
    return F.when((precision > 0) & (recall > 0), F.round(2 * precision * recall / (precision + recall), 4))


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def epoch_seconds(when: Column) -> Column:
    """Whole seconds since 1970 UTC of a date or a timestamp, whatever its unit; dates are midnights UTC."""
    return F.unix_seconds(when.cast("timestamp"))


def interval_text(mean: Column, lo: Column, hi: Column, digits: int = 4) -> Column:
    """Such as 0.1291 [0.1065, 0.1529]; null where a part is."""
    return F.when(mean.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", mean, lo, hi))


def looked_up(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The value of a small table for a key, or the default."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None)
    return F.coalesce(found, F.lit(default))
