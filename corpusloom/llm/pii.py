"""Operator 2: personal data in texts.

Patterns propose spans, checksums confirm them, words nearby adjust the score of the kinds that the method adds.

The base kinds (email, ip, card, phone) are found leftmost and without overlap per kind; a match that fails its check is
dropped and not tried again in part. The added kinds count from a score of ACCEPT on. A pattern alone is worth little; a
checksum, a country's length or a value that looks random is worth more; a word such as "iban", "social security" or "call"
within NEAR characters adds to it, and one such as "part", "invoice" or "commit" takes from it, so either can turn a verdict.

iban: mod-97, with the length of its country or else only with context. ssn: ranges that are in use, only with context. tel:
national phone numbers of ten digits, only with context. secret: values assigned to names such as token, password or api_key
that look random, keys of well-known forms, private key blocks, and long hexadecimal runs, these only with context.

Defined results: null and empty texts have no spans; positions are code points, the end excluded; a text of any length is
scanned in time linear in its length (every pattern is anchored so that no start is tried twice; an IBAN's start looks at
most 34 characters and their blanks ahead); spans of different kinds may overlap; equal rows give equal results; columns
other than the id and the text are ignored by detect() and handed through by redacted().
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, recount, rewritten, text_pieces

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel", "secret")
BASE = KINDS[:4]
NEAR, ACCEPT = 48, 0.6
CHUNK = 1 << 18

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})")
_IBAN_CHAR, _ALNUM = re.compile(r"[A-Z0-9]"), re.compile(r"[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Characters of an IBAN by country, blanks not counted.
IBAN_LENGTHS = {
    k: int(n)
    for n, ks in (x.split(":") for x in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA",
        "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV",
        "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    ))
    for k in ks.split()
}
_TEL = re.compile(r"(?<![0-9+().-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NAMES = ("token", "secret", "passw", "pwd", "key", "credential", "auth", "bearer")
_ASSIGNED = re.compile(
    r"""(?:token|secret|password|passwd|pwd|(?:api|access|private|secret|auth|encryption)[_-]?key|credentials?)["']?[ \t]{0,3}(?::=|=>|=|:)[ \t]{0,3}["']?([^\s"'<>,;]{8,}+)""", re.I
)
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[sr]k_live_[A-Za-z0-9]{24,}+|xox[abprs]-[A-Za-z0-9-]{20,}+)(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])")
_BEGIN, _END = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY-----")
#: Words that make a kind likelier, and words that make it less so.
_CONTEXT = {
    "iban": (r"iban|bic|swift|konto|kontonummer|account|bank|compte|cuenta", r"serial|model|order|part|isbn"),
    "ssn": (r"ssn|social security|sozialversicherung|securite sociale|seguro social", r"part|order|invoice|serial|model|isbn"),
    "tel": (r"tel|telephone|phone|call|fax|mobile|cell|fon|telefon|telefono|téléphone|teléfono|appelez|llame", r"part|order|invoice|serial|model|isbn"),
    "secret": (r"token|secret|password|passwd|api[ _-]?key|access[ _-]?key|credentials?|auth|bearer", r"commit|sha1|sha256|md5|checksum|hash|digest|revision"),
}
_CONTEXT = {k: tuple(re.compile(rf"(?<![A-Za-z])(?:{x})(?![A-Za-z])", re.I) for x in v) for k, v in _CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def emails(text: str):
    """For each @ the run of local characters before it (not into the last match) and the longest domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            begin = at
            while begin > done and _NOT_LOCAL.match(text, begin - 1) is None:
                begin -= 1
            if begin < at:
                yield begin, m.end()
                done = m.end()
                at = text.find("@", done)
                continue
        done, at = at + 1, text.find("@", at + 1)


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(x) < 4 and int(x) < 256 or int(x.lstrip("0")[:4] or 0) < 256 for x in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _near(kind: str, text: str, begin: int, end: int) -> int:
    """1 with a word nearby that speaks for the kind, -1 with one that speaks against it, 0 with none or both."""
    around = text[max(0, begin - NEAR) : begin] + " " + text[end : end + NEAR]
    for_, against = (bool(p.search(around)) for p in _CONTEXT[kind])
    return for_ - against


def iban_ends(text: str, begin: int):
    """Where an IBAN from begin on may end: at its country's length, whatever follows a blank, or with the whole run."""
    end = begin
    for _ in range(IBAN_LENGTHS.get(text[begin : begin + 2], 0)):
        end += text.startswith(" ", end)
        if not _IBAN_CHAR.match(text, end):
            break
        end += 1
    else:
        if end > begin and not _ALNUM.match(text, end):
            yield end
    if m := _IBAN.match(text, begin):
        yield m.end()


def ibans(text: str):
    done = 0
    for m in _IBAN_START.finditer(text):
        begin = m.start()
        if begin < done:
            continue
        for end in iban_ends(text, begin):
            if mod97(text[begin:end].replace(" ", "")):
                code = text[begin:end].replace(" ", "")
                known = IBAN_LENGTHS.get(code[:2]) == len(code)
                yield begin, end, (0.7 if known else 0.4) + 0.2 * _near("iban", text, begin, end)
                done = end
                break


def ssns(text: str):
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield *m.span(), 0.3 + 0.5 * _near("ssn", text, *m.span())


def tels(text: str):
    for m in _TEL.finditer(text):
        digits = [c for c in m[0] if c.isdigit()]
        if digits[0] not in "01":
            yield *m.span(), 0.3 + 0.4 * _near("tel", text, *m.span())


def random_looking(value: str) -> bool:
    """Letters and digits mixed, of many kinds for the length."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= min(8, len(value) - 1)


def secrets(text: str):
    lower, found = text.lower(), []
    if any(n in lower for n in _NAMES):
        for m in _ASSIGNED.finditer(text):
            value, long_ = m[1].rstrip(".,;:!?)]}*%$#&|"), 0.0
            if len(value) >= 8 and random_looking(value):
                long_ = 0.3 if len(value) >= 16 else 0.1
                found.append((m.start(1), m.start(1) + len(value), 0.5 + long_))
        found += [(*m.span(), 0.3 + 0.4 * _near("secret", text, *m.span())) for m in _HEX.finditer(text) if random_looking(m[0])]
    if "AKIA" in text or "ASIA" in text or "_" in text or "xox" in text:
        found += [(*m.span(), 0.9) for m in _KNOWN.finditer(text)]
    if "-----BEGIN" in text:
        done = 0
        for m in _BEGIN.finditer(text):
            if m.start() >= done and (e := _END.search(text, m.end())):
                done = e.end()
                found.append((m.start(), done, 1.0))
    done = 0
    for begin, end, score in sorted(found, key=lambda x: (x[0], -x[2], -x[1])):
        if begin >= done and score >= ACCEPT:
            done = end
            yield begin, end, score


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score), by start, then kind as listed in KINDS. Base kinds have score 1."""
    if not text:
        return []
    found = []
    for kind, finder, mark in (("email", emails, "@"), ("ip", ips, "."), ("card", cards, ""), ("phone", phones, "+")):
        if mark in text:
            found += [(b, e, kind, 1.0) for b, e in finder(text)]
    for kind, finder in (("iban", ibans), ("ssn", ssns), ("tel", tels), ("secret", secrets)):
        found += [(b, e, kind, s) for b, e, s in finder(text) if s >= ACCEPT]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, e, k, *_ in spans)


def redact(text: str | None) -> str | None:
    """Each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        begin, end, kind, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:begin], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def _scan(batches):
    for b in batches:
        for begin, end, texts in text_pieces(b, 1, CHUNK):
            found = [find_spans(t) for t in texts]
            base = [[s for s in x if s[2] in BASE] for x in found]
            spans = pa.array([[{"start": s, "end": e, "kind": k, "score": v} for s, e, k, v in x] for x in found], _SPANS)
            digest = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), spans, digest], ["doc_id", "found", "base_sha256"])


def detect(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, found (array of start, end, kind, score), base_sha256."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bounded_batches(d.sparkSession)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(_scan), f"doc_id {kind}, found array<struct<start:int,end:int,kind:string,score:double>>, base_sha256 string")


def _redact(batches):
    for b in batches:
        yield from rewritten(b, "text", CHUNK, lambda texts, *_: [redact(t) for t in texts])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with their text redacted; every other column as it was, but n_chars, where there is one, counts the new text."""
    bounded_batches(docs.sparkSession)
    return recount(docs.mapInArrow(lean(_redact), docs.schema), docs)
