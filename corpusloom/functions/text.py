"""Scalar text functions. Everything but Unicode normalisation and case folding is a Catalyst expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# The 29 blanks and the code points that cleaning deletes, as regex classes.
BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DELETED = r"[\x00-\x08\x0E-\x1B\x7F-\x{84}\x{86}-\x{9F}\x{FFFD}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
LATIN_LETTER = r"[A-Za-zÀ-ỹ]"

# The tag patterns, in order.
TAG_PATTERNS = {
    "has_error": r"\b(error|failed|failure|exception|cannot|can't|unable|not found|lỗi|không thể|thất bại)\b",
    "has_command": r"(?:^|\s)(?:sudo |pip(?:3)? |apt(?:-get)? |dnf |yum |npm |git |python(?:3)? |cd |ls(?: |$)|mkdir |rm |cp |mv |curl |wget )",
    "has_ui": r"\b(menu|button|dialog|window|settings|option|click|save|cancel|giao diện|trình đơn|nút|hộp thoại|thiết lập)\b",
    "has_code_or_api": r"\b(api|sdk|function|class|variable|python|java(?:script)?|typescript|json|xml|yaml|html|css|mã nguồn|hàm)\b|`[^`]+`",
    "has_path": r"(?:[A-Za-z]:\\\\|/(?:[^\s/]+/)+|\b[^\s/]+\.(?:py|js|json|xml|html|txt|md|csv|ya?ml|ini|conf)\b)",
    "has_config": r"\b(config(?:uration)?|settings?|\.ini|\.conf|yaml|json|cấu hình|thiết lập)\b",
    "has_version": r"\b(?:version|v?\d+(?:\.\d+){1,3}|python \d|cuda \d|phiên bản)\b",
}
CASE_SENSITIVE_TAGS = ("has_path",)
GUIDE_PATTERN = r"\b(how to|please|guide|tutorial|install|configure|hướng dẫn|cách |cài đặt|khắc phục)\b"
GROUPS = ("CLI / Command", "Software / UI", "Hỗ trợ kỹ thuật / xử lý sự cố", "Code & Technical Reference")
SEPARATOR = "␟"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D"), na_action="ignore")


@F.pandas_udf(IntegerType())
def graphemes(s: pd.Series) -> pd.Series:
    import regex

    return s.map(lambda x: len(regex.findall(r"\X", x)), na_action="ignore").astype("Int32")


def blanks_collapsed(c: Column) -> Column:
    one = F.regexp_replace(c, BLANKS + "+", " ")
    return F.regexp_replace(one, "^ | $", "")


def clean(c: Column) -> Column:
    """NFC, runs of blanks to one space, no blank at the ends."""
    return blanks_collapsed(nfc(c))


def match_key(c: Column) -> Column:
    """What two texts share if they are the same but for compatibility forms, case and blanks."""
    return blanks_collapsed(folded(c))


def input_normalized(c: Column) -> Column:
    """As clean, but control and replacement characters are deleted first."""
    return clean(F.regexp_replace(c, DELETED, ""))


def has_control(c: Column) -> Column:
    return c.rlike(CONTROL) | c.contains("�")


def has_letter(c: Column) -> Column:
    return c.rlike(LATIN_LETTER)


def length_ratio(a: Column, b: Column) -> Column:
    return F.length(a) / F.greatest(F.length(b), F.lit(1))


def pair_hash(a: Column, b: Column) -> Column:
    """SHA-256 of the compact JSON array of both texts."""
    return F.sha2(F.to_json(F.array(a, b)), 256)


def key_hash(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(a, F.lit(SEPARATOR), b), 256)


def stable_rank(c: Column, seed: str) -> Column:
    """Orders values by a seeded hash: 16 hex digits sort as the number they write."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c), 256), 1, 16)


def tags(en: Column, vi: Column) -> Column:
    text = F.concat(en, F.lit("\n"), vi)
    found = [F.when(text.rlike(("(?U)" if k in CASE_SENSITIVE_TAGS else "(?iU)") + p), F.lit(k)) for k, p in TAG_PATTERNS.items()]
    return F.array_compact(F.array(*found))


def group_of(en: Column, vi: Column, found: Column) -> Column:
    """The main group by the first rule that fits, and whether a rule chose it."""
    has = lambda *names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    make = lambda name, how: F.struct(F.lit(name).alias("primary_group"), F.lit(how).alias("group_method"))
    guide = F.concat(en, F.lit(" "), vi).rlike("(?iU)" + GUIDE_PATTERN)
    return (
        F.when(has("has_command"), make(GROUPS[0], "rule_based"))
        .when(has("has_ui"), make(GROUPS[1], "rule_based"))
        .when(has("has_error") | guide, make(GROUPS[2], "rule_based"))
        .when(has("has_code_or_api", "has_path", "has_config", "has_version"), make(GROUPS[3], "rule_based"))
        .otherwise(make(GROUPS[3], "default_group"))
    )


def title(c: Column, most: int = 60) -> Column:
    """The first line, cut to `most` characters with an ellipsis."""
    line = F.trim(F.get(F.split(F.trim(c), "\n"), F.lit(0)))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.left(line, F.lit(most - 1))), F.lit("…")))


def day_bucket(day: Column, today: Column) -> Column:
    """0 today or later, 1 yesterday, 2 within 7 days, 3 within 30, 4 older."""
    n = F.datediff(today, day)
    return F.when(n <= 0, 0).when(n == 1, 1).when(n < 7, 2).when(n < 30, 3).otherwise(4)


def decode_limit(n_tokens: Column, most: int = 512) -> Column:
    return F.least(F.lit(most), 2 * n_tokens + 20)


def safe_relative_path(p: Column) -> Column:
    parts = F.split(p, "/")
    return (p != "") & ~p.startswith("/") & ~p.contains("\\") & ~F.exists(parts, lambda x: x.isin("", ".", ".."))


IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def total_time(*parts: Column) -> Column:
    """Sum of the parts that are there; null if none is."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def language_guess(marked: Column, plain: Column, shape: Column, english: Column, foreign: Column) -> Column:
    """Decision over the word counters of a text: vi_high, en_high, mixed or uncertain."""
    words = marked + plain + shape + english + foreign
    quoting = ((english >= 2) & (english > marked + plain)) | ((english >= 1) & (english + foreign >= 2 * (marked + plain)))
    some_english = ((english >= 2) & (english > shape)) | ((shape == 0) & (((english >= 1) & (foreign >= 2)) | (foreign >= 3)))
    mostly_english = (english >= 2) & (english >= 3 * plain) & (english + foreign >= F.floor((words * 3 + 4) / 5))
    bare_vietnamese = (plain >= 2) & (plain > english) & (plain + shape >= english + foreign)
    return (
        F.when(words == 0, "uncertain")
        .when(marked > 0, F.when(quoting, "mixed").otherwise("vi_high"))
        .when((plain == 0) & some_english, "en_high")
        .when(mostly_english, "en_high")
        .when(bare_vietnamese, "vi_high")
        .when((plain + shape >= 2) & (english >= 2), "mixed")
        .otherwise("uncertain")
    )


# Onsets, vowel groups, final consonants, and the vowel groups that may precede one.
ONSETS = "ngh ng nh ch gh gi kh ph qu th tr b c d g h k l m n p r s t v x"
NUCLEI = "a e i o u y ai ao au ay eo eu ia ie iu oa oe oi oo ua ue ui uo uu uy ya ye oai oay oao oeo uay uoi uou uya uye uyu ieu yeu"
CODAS = "ng nh ch c m n p t"
CLOSED = "ie uo uye oa oe ua ue ye uy ia"


def _syllable_pattern() -> str:
    """One pattern for an unaccented syllable: onset, then an open rhyme or one that a final consonant may close."""
    nuclei, closed = NUCLEI.split(), set(CLOSED.split())
    closing = [n for n in nuclei if n[-1] not in "iyou" or len(n) == 1 or n in closed]
    alt = lambda xs: "(?:" + "|".join(sorted(xs, key=lambda x: (-len(x), x))) + ")"
    return f"^{alt(ONSETS.split())}?(?:{alt(nuclei)}|{alt(closing)}{alt(CODAS.split())})$"


SYLLABLE = _syllable_pattern()


def is_bare_syllable(word: Column) -> Column:
    return (F.length(word) <= 7) & ~word.rlike("[^a-z]|[fjwz]") & word.rlike(SYLLABLE)


ID = r"^c[0-9]{8}-[0-9]{9}-[0-9a-f]{4}$"


def new_id(at: Column, random: Column) -> Column:
    """An id that sorts by time: c, date, time to the millisecond in the session's zone, the last 16 bits of a random number."""
    return F.concat(F.lit("c"), F.date_format(at, "yyyyMMdd-HHmmssSSS"), F.lit("-"), F.lpad(F.lower(F.hex(random.bitwiseAND(0xFFFF))), 4, "0"))


def is_utc(stamp: Column) -> Column:
    """Whether it is an ISO date and time that exists, with an offset of zero; null is not."""
    shape = stamp.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(\+00:00|Z)$")
    return F.coalesce(shape & F.try_to_timestamp(stamp).isNotNull(), F.lit(False))


@F.pandas_udf(StringType())
def invisible_escaped(s: pd.Series) -> pd.Series:
    """JSON text with its non-ASCII controls, blanks and marks, and U+FFFD, as escapes; what it decodes to stays."""

    def escaped(c: str) -> str:
        if c < "\x7f" or (c != "\ufffd" and unicodedata.category(c)[0] not in "CZM"):
            return c
        units = c.encode("utf-16-be")
        return "".join(f"\\u{units[i]:02x}{units[i + 1]:02x}" for i in range(0, len(units), 2))

    return s.map(lambda x: x if x.isascii() and "\x7f" not in x else "".join(map(escaped, x)), na_action="ignore")


def code_point_ranges(points: Column) -> Column:
    """An array of code points, in any order and repeated, as 'U+0000-U+0008 U+000E'."""
    once = F.array_sort(F.array_distinct(points))
    begins, ends = F.array_except(once, F.transform(once, lambda x: x + 1)), F.array_except(once, F.transform(once, lambda x: x - 1))
    name = lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(x), F.greatest(F.length(F.hex(x)), F.lit(4)), F.lit("0")))
    return F.array_join(F.zip_with(begins, ends, lambda a, b: F.when(a == b, name(a)).otherwise(F.concat(name(a), F.lit("-"), name(b)))), " ")
