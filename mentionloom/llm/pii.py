"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, scheme marks and identifier
cues. At each anchor a deterministic local parser expands to the boundaries of an email, an address or an account
number and validates it. Nothing else of the text is parsed."""

from __future__ import annotations

import hashlib
import re
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.llm.common import small_batches

#: Kinds in the order that breaks ties of spans; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "login", "account")
BASE = KINDS[:4]
#: What takes the place of a span in redacted text.
MASKS = {k: f"[{k.upper()}]" for k in KINDS}
#: Words that announce an account or identity number.
CUES = ("iban", "account", "acct", "ssn", "passport")
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9]+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Ends at a slash, so each stretch is read once.
LOGIN = re.compile(r"://([^\s/@:]+:[^\s/@]+)@")
LEAD = r"(?:[\x20_-]?(?:no|number|nr|id)(?![A-Z]))?(?:[.:#=]{1,2}\x20?|\x20|(?=[0-9]))"
#: A run with at least six letters and digits, of whatever length, or groups of four digits.
NUMBER = re.compile(LEAD + r"([0-9]{4}(?:\x20[0-9]{4})+(?:\x20[0-9]{1,4})?(?![A-Z0-9])|[A-Z]{0,4}[0-9][A-Z0-9-]{4,}[0-9])", re.IGNORECASE | re.ASCII)
#: As printed, in groups, or in one run.
IBAN = re.compile(LEAD + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})", re.IGNORECASE | re.ASCII)
#: Three, two and four digits; no part is all zeros, and the first is neither 666 nor over 899.
SSN = re.compile(r"(?!000|666|9)[0-9]{3}(-?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}", re.ASCII)
PASSPORT = re.compile(r"[A-Z]{0,2}[0-9]{6,9}[A-Z]?", re.IGNORECASE | re.ASCII)
#: What a number after a cue has to be, from end to end; the others are known by no form, an IBAN by its check digits.
FORMS = {"ssn": SSN, "passport": PASSPORT}
#: Characters of an IBAN, by country. Those of any other country have 15 to 34.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}.items() for c in countries.split()}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", "@")
    found.add_word("+", "+")
    found.add_word("://", "://")
    for d in DIGITS:
        found.add_word(d, "0")
    for cue in CUES:
        for form in map("".join, product(*zip(cue, cue.upper(), strict=True))):
            found.add_word(form, cue)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the IBAN ends that starts the groups text[start:end]; None if there's none. It ends with a group."""
    at = [i for i in range(start, end) if text[i] != " "]
    code = "".join(text[i] for i in at).upper()
    known = IBAN_LENGTHS.get(code[:2])
    for n in [known] if known else range(len(code), 14, -1):
        if n <= len(code) and not (text[at[n - 1] + 1 : at[n - 1] + 2].isascii() and text[at[n - 1] + 1 : at[n - 1] + 2].isalnum()):
            if int("".join(str(int(c, 36)) for c in code[4:n] + code[:4])) % 97 == 1:
                return at[n - 1] + 1
    return None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, ends exclusive.

    For each base kind the spans are the leftmost ones that don't overlap; what fails validation is passed over
    whole. Account numbers that meet a base span are left to it, but for an IBAN, of whose digits a card may be a part."""
    found: list[tuple[int, int, str]] = []
    ibans = set()
    after = dict.fromkeys((*KINDS, "quad"), 0)
    for last, kind in anchors.iter(text):
        if kind == "0":
            if last >= after["card"]:
                if m := CARD.match(text, last):
                    after["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((last, m.end(), "card"))
                else:
                    after["card"] = last + 1
            if last >= after["ip"]:
                if m := QUAD.match(text, last):
                    after["ip"] = m.end()
                    # a part may have any number of leading zeros
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                        found.append((last, m.end(), "ip"))
                else:
                    after["ip"] = RUN.match(text, last).end()
        elif kind == "@":
            start = last
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                after["email"] = m.end()
                found.append((start, m.end(), "email"))
        elif kind == "+":
            if last >= after["phone"] and (m := PHONE.match(text, last)):
                after["phone"] = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found.append((last, m.end(), "phone"))
        elif kind == "://":
            if m := LOGIN.match(text, last - 2):
                found.append((m.start(1), m.end(1), "login"))
        # a cue inside a number announces no other, and one inside a word none at all
        elif last >= after["account"] and not text[max(0, last - len(kind)) : last - len(kind) + 1].isalnum():
            if (m := IBAN.match(text, last + 1)) and (end := iban_end(text, m.start(1), m.end(1))):
                after["account"] = end
                ibans.add((m.start(1), end, "account"))
                found.append((m.start(1), end, "account"))
            elif kind != "iban" and (m := NUMBER.match(text, last + 1)):
                after["account"] = m.end(1)
                if kind not in FORMS or FORMS[kind].fullmatch(m[1]):
                    found.append((m.start(1), m.end(1), "account"))
    base = [x for x in found if x[2] in BASE]
    if len(base) < len(found):
        found = base + [x for x in found if x[2] not in BASE and (x in ibans or not any(b[0] < x[1] and x[0] < b[1] for b in base))]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every stretch of overlapping spans replaced by the mask of its first span."""
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], MASKS[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, found (array of start, end, kind) and redacted text of every row.

    Besides the base kinds, user and password of a URL are a ``login``, and the number after a cue an ``account``: an IBAN
    whose length and check digits hold, a number of the form that the cue asks for, or any run of six letters and digits or
    more. Texts are read whole, and no span is cut, however long. A null text has no spans and stays null; an empty one has
    none. Rows are independent: repeated rows get equal results, other columns don't matter."""
    small_batches(docs.sparkSession)

    def search(batches):
        anchors = automaton()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [spans(t, anchors) if t else [] for t in texts]
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in found]
            clean = [redact(t, x) if x else t for t, x in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind), pa.array(clean, pa.string())], names=["key", "found", "redacted"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(search, f"key {rows.schema['key'].dataType.simpleString()}, found array<struct<start:int,end:int,kind:string>>, redacted string")
    return out.withColumnRenamed("key", key)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with masked text, and the length that goes with it; all other columns as they are."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("key"), F.col(text).alias("text"))
    out = find_pii(packed, key="key", text="text")
    column = {c: F.col(f"key.{n}") for c, n in names.items()} | {text: F.col("redacted")}
    if "n_chars" in names:
        column["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return out.select(*[column[c].alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and span lists of every document."""
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
