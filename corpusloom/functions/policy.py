"""The ordered rules for texts before and after translation. Arrow functions find evidence in one pass over a batch; the
decisions over it are Catalyst expressions. Lexicon and word lists are parameters, small and sent with the function."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .literals import INVARIANT, W, Lexicon, Literal, Literals, bare

MAX_CHARS, SHORT_WORD = 500, 40
# Letters that only Vietnamese has among Latin scripts, and all its letters with marks.
VI_ONLY = "ảạăằắẳẵặâầấẩẫậẻẽẹêềếểễệỉĩịỏọôồốổỗộơờớởỡợủũụưừứửữựỳỷỹỵđ"
VI_MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
# Pairs of unmarked words that are Vietnamese together, and words that are no evidence of either language.
VI_PAIRS = """cam on,xin loi,xin chao,tam biet,co the,khong the,lam on,the nao,nhu the,bao nhieu,tai sao,o dau,bay gio,hom nay,ngay mai,
hom qua,cam ta,the thi,the la,do la,an toan,to chuc,can thiet,to di,to la,on roi,on ma,on khong,no di,no la,no o,o day,di day,den day,
the nay,the do,the kia,day la,ve nha,an com,di lam""".replace("\n", "").split(",")
NEUTRAL = "me can so hang long sang ten man may chat pin song net bus cam ok okay day".split()
# What may follow a term or a context word's last word in a translation.
TERM_ENDINGS = "s|es|'s|’s|ed|ing|ized|izing"
WORD_ENDINGS = "s|es|ed|d|ing|er|ers|'s|’s|site|sites|page|pages|hook|hooks|server|app|apps"

# Short lists of our own; a deployment gives its full ones.
ENGLISH = """the a an i you he she it we they this that these those is are was were be been am do does did have has had will would
should could please how what when where who why which and or but if then not of to in on at for with from by about your our their my
his its there here very need want make know thanks hello""".split()
VIETNAMESE = """toi ban khong duoc chua roi dang cung deu rat qua lam nhieu cua voi trong ngoai tren duoi nay nao nhu va la cho tu den
len xuong nguoi viec ngay gio tieng viet kiem tra loi sua tao dong chay gui nhan khi phai muon biet hieu xin chao mot hai nhung cac""".split()

_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’]\p{L}+)?")
_OPENERS = "\"'“‘([*-"
_SYLLABLE = regex.compile(T.SYLLABLE)


@dataclass(frozen=True)
class Words:
    """Word lists of the language evidence, lower case; neutral words count for neither language."""

    english: frozenset = frozenset(ENGLISH)
    vietnamese: frozenset = frozenset(VIETNAMESE)
    pairs: frozenset = frozenset(VI_PAIRS)
    neutral: frozenset = frozenset(NEUTRAL)

    @classmethod
    def of(cls, english, vietnamese) -> Words:
        return cls(frozenset(english) - set(NEUTRAL), frozenset(vietnamese) - set(NEUTRAL))

    def known(self, w: str) -> bool:
        return w in self.english or w in self.vietnamese or w in self.neutral


@dataclass
class Policy:
    lexicon: Lexicon = field(default_factory=Lexicon)
    words: Words = Words()

    def __post_init__(self):
        self.literals = Literals(self.lexicon, self.words.known, self.words.english.__contains__)

    # --- one text

    def evidence(self, text: str) -> dict[str, int]:
        """Words by what they tell of the language: marked, plain, shape, english, foreign. Literals and names tell nothing."""
        masked = list(text)
        for s in self.literals.spans(text):
            masked[s.start : s.end] = " " * (s.end - s.start)
        masked = "".join(masked)
        n = dict.fromkeys(("marked", "plain", "shape", "english", "foreign"), 0)
        found = [(m.start(), m[0], m[0].lower()) for m in _WORD.finditer(masked)]
        at = 0
        while at < len(found):
            start, typed, w = found[at]
            if at + 1 < len(found) and f"{w} {found[at + 1][2]}" in self.words.pairs:
                n["plain"] += 2
                at += 2
                continue
            at += 1
            kind = self._word_kind(w, capitals=len(typed) >= 2 and typed == typed.upper())
            name = typed[0].isupper() and not _opens_sentence(masked, start)
            if kind and (kind == "english" or not name):
                n[kind] += 1
        return n

    def _word_kind(self, w: str, capitals: bool) -> str | None:
        if any(c in VI_ONLY for c in w):
            return "marked"
        if not w.isascii():
            return "marked" if any(c in VI_MARKED for c in w) and _is_syllable(_unmarked(w)) else None
        if (len(w) == 1 and w not in "ai") or w in self.words.neutral or capitals:
            return None
        if w in self.words.english:
            return "english"
        if w in self.words.vietnamese:
            return "plain"
        return "shape" if _is_syllable(w) else "foreign"

    def features(self, text: str, direction: str) -> dict:
        """What the input rules ask of a normalised text; one that is empty or too long is not looked at further."""
        other = "_to_".join(reversed(direction.split("_to_")))
        length = len(regex.findall(r"\X", text))
        out = {"length": length, "literal": None, "context": False, "dialogue": False, "other_dialogue": False, "one_word": False, "vietnamese_letter": False}
        if not 0 < length <= MAX_CHARS:
            return out | dict.fromkeys(("marked", "plain", "shape", "english", "foreign"), 0)
        from .literals import key

        k, b = key(text), bare(text)
        said = self.lexicon.dialogue
        return out | self.evidence(text) | {
            "literal": self.literals.whole(text),
            "context": k in self.lexicon.context,
            "dialogue": k in said.get(direction, ()),
            "other_dialogue": k in said.get(other, ()),
            "one_word": len(b.split()) == 1 and len(regex.findall(r"\X", b)) <= SHORT_WORD,
            "vietnamese_letter": any(c in VI_ONLY for c in text.lower()),
        }

    def output_check(self, source: str, output: str, english: bool) -> dict:
        """reason (null if the output stands), the literals it lost, and the terms of the source it doesn't have."""
        if not output.strip():
            return {"reason": "empty_output", "missing": [], "check_terms": []}
        missing = [s.text for s in self.literals.spans(source) if s.kind in INVARIANT and not literal_kept(s, output)]
        if missing:
            return {"reason": "lost_literal", "missing": missing, "check_terms": []}
        lost = [t for t in dict.fromkeys(x.text for x in self.lexicon.find(source)) if not _term_pattern(t).search(output)]
        if not english:
            lost += [t for t in self.lexicon.find_context(source) if t not in lost and not _inflected_pattern(t).search(output)]
        return {"reason": None, "missing": [], "check_terms": lost}

    # --- columns

    def spans(self, c: Column) -> Column:
        """array<struct<start, end, kind, text>>, by start; null for null."""
        literals = self.literals

        @F.pandas_udf("array<struct<start:int,end:int,kind:string,text:string>>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: [t._asdict() for t in literals.spans(x)], na_action="ignore")

        return run(c)

    def whole(self, c: Column) -> Column:
        """The kind if a text is a literal as a whole, else null. Filters on it stay above a distinct below it, since it is
        declared to be non-deterministic; it is not."""
        literals = self.literals

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(literals.whole, na_action="ignore")

        return run.asNondeterministic()(c)

    def language_evidence(self, c: Column) -> Column:
        evidence = self.evidence

        @F.pandas_udf("marked int, plain int, shape int, english int, foreign int")
        def run(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([evidence(x or "") for x in s], columns=["marked", "plain", "shape", "english", "foreign"])

        return run(c)

    def input_features(self, text: Column, direction: Column) -> Column:
        """The features of a normalised text; of null, those of the empty one."""
        features = self.features
        names = "length int, literal string, context boolean, dialogue boolean, other_dialogue boolean, one_word boolean, vietnamese_letter boolean, marked int, plain int, shape int, english int, foreign int"

        @F.pandas_udf(names)
        def run(s: pd.Series, d: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([features(x or "", y) for x, y in zip(s, d, strict=True)], columns=[n.split()[0] for n in names.split(", ")])

        return run(text, direction)

    def checked(self, source: Column, output: Column, direction: Column) -> Column:
        """struct<reason, missing, check_terms>; null texts count as empty."""
        check = self.output_check

        @F.pandas_udf("reason string, missing array<string>, check_terms array<string>")
        def run(s: pd.Series, o: pd.Series, d: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([check(x or "", y or "", z == "en_to_vi") for x, y, z in zip(s, o, d, strict=True)], columns=["reason", "missing", "check_terms"])

        return run(source, output, direction)


def _opens_sentence(text: str, at: int) -> bool:
    at -= 1
    while at >= 0 and (text[at].isspace() or text[at] in _OPENERS):
        at -= 1
    return at < 0 or text[at] in ".!?…:;"


def _unmarked(w: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn").replace("đ", "d")


def _is_syllable(w: str) -> bool:
    return len(w) <= 7 and not regex.search("[^a-z]|[fjwz]", w) and bool(_SYLLABLE.match(w))


def literal_kept(s: Literal, output: str) -> bool:
    """A status as a number of its own, code but for blanks, addresses in any case, the rest as it is."""
    if s.kind == "HTTP_STATUS":
        return bool(regex.search(rf"(?<!\p{{N}}){regex.escape(s.text)}(?!\p{{N}})", output))
    if s.kind == "CODE":
        return "".join(s.text.split()) in "".join(output.split())
    return s.text.lower() in output.lower() if s.kind in ("URL", "EMAIL") else s.text in output


@lru_cache(4096)
def _term_pattern(term: str):
    """The term in any case; blanks and hyphens may come and go in it; an ending may follow."""
    out = []
    for before, c in zip(" " + term, term, strict=False):
        if out:
            out.append(r"\s?" if c in ".-/+#" or before in ".-/+#" else r"[\s-]?")
        out.append(r"[\s-]?" if c in " -" else regex.escape(c))
    return regex.compile(rf"(?i)(?<![{W}]){''.join(out)}(?:{TERM_ENDINGS})?(?![{W}])")


@lru_cache(4096)
def _inflected_pattern(term: str):
    *head, last = term.split(" ")
    e = regex.escape
    forms = [e(last) + f"(?:{WORD_ENDINGS})?", e(last + last[-1]) + "(?:ed|ing|er|ers)"]
    forms += [e(last[:-1]) + "(?:ing|ed|ion|er|ers)"] * last.endswith("e") + [e(last[:-1]) + "(?:ies|ied)"] * last.endswith("y")
    return regex.compile(rf"(?i)(?<![{W}]){''.join(e(w) + r'[\s-]+' for w in head)}(?:{'|'.join(forms)})(?![{W}])")


def hints_other_language(e: Column, english_source: Column) -> Column:
    vi = e["marked"] + e["plain"]
    return F.when(english_source, (vi > 0) & (e["english"] == 0)).otherwise((vi == 0) & (e["english"] > 0))


def lacks_diacritics(e: Column) -> Column:
    """Clearly Vietnamese words, none with its marks."""
    vi = e["plain"] + e["shape"]
    clear = (e["plain"] >= 2) | ((e["plain"] >= 1) & (e["shape"] >= 1))
    return ~e["vietnamese_letter"] & (e["marked"] == 0) & clear & (vi >= 2) & (vi >= e["english"])


def decision(f: Column, direction: Column, override: Column | None = None, skip_mismatch: Column | None = None) -> Column:
    """struct<action, notes, guess, suggested> from input_features: empty, too_long, keep, mismatch or translate.

    The first rule that fits decides: length, whole literal, context term, dialogue word, language of the text."""
    override, skip = (F.lit(False) if c is None else c for c in (override, skip_mismatch))
    english = direction == "en_to_vi"
    own, other = F.when(english, "en_high").otherwise("vi_high"), F.when(english, "vi_high").otherwise("en_high")
    guess = F.when(f["other_dialogue"], other).otherwise(T.language_guess(f["marked"], f["plain"], f["shape"], f["english"], f["foreign"]))
    mismatch = guess == other
    unsure = (guess == "uncertain") & ~f["one_word"] & hints_other_language(f, english)
    notes = F.array_compact(
        F.array(
            F.when(f["one_word"], "SHORT_INPUT"),
            F.when(mismatch & override, "LANGUAGE_OVERRIDDEN").when(unsure, "LANGUAGE_UNCERTAIN"),
            F.when(~english & lacks_diacritics(f), "NO_DIACRITICS"),
        )
    )
    none = F.array().cast("array<string>")
    suggested = F.when(english, "vi_to_en").otherwise("en_to_vi")
    make = lambda action, notes=none, guess=F.lit(None).cast("string"), to=F.lit(None).cast("string"): F.struct(
        F.lit(action).alias("action"), notes.alias("notes"), guess.alias("guess"), to.alias("suggested")
    )
    return (
        F.when(f["length"] == 0, make("empty"))
        .when(f["length"] > MAX_CHARS, make("too_long"))
        .when(f["literal"].isNotNull(), make("keep", F.array(F.lit("KEPT_LITERAL"))))
        .when(f["context"], make("keep", F.array(F.lit("CONTEXT_TERM"))))
        .when(f["dialogue"], make("translate", guess=own))
        .when(mismatch & ~override & ~skip, make("mismatch", guess=guess, to=suggested))
        .otherwise(make("translate", notes, guess))
    )
