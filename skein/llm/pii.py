"""Personal data replaced by surrogates: keyed, of the same type and format, distinct and consistent over the corpus.

Detected: e-mail addresses, IBANs, long hexadecimal or prefixed secrets, IPv4 addresses, social-security and phone numbers, card and
account numbers, and names after a title.  Surrogates of the first kinds are keyed permutations (a Feistel network with cycle
walking) of the characters within each character's own alphabet, so the length, separators, letter case and script stay, equal
entities get equal surrogates and different ones of one format different ones; country prefixes stay, and a number with a valid check digit gets a valid
one.  Names get generated names of the same script, letter case and gender (from the title); a family name has one
surrogate under every title.

Collisions are checked over the whole corpus: no two entities of a type may share a surrogate, and no surrogate may be some
other entity that the corpus holds.  Entities that fail are keyed anew until none does.  Where WIDE attempts did not help, the format is full or
nearly so, and the surrogate gets a character (names: a syllable) more with each further attempt, so that the rounds end.  Up to FEW of those
exceptions are broadcast; beyond that they are joined with the texts that hold them.

Defined cases: null text stays null, empty text stays empty; repeated rows get equal results; other columns are not read by
`entities` and `replace` and pass unchanged through `redact`.
"""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut

NUMERIC = re.compile(
    r"(?P<email>[^\s@<>()\[\],;:\"|*#$%&!?=]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?!\w))"
    r"|(?P<secret>(?<!\w)(?:(?:AKIA|ASIA|ghp_|gho_|sk-|pk-|xox[abp]-)[A-Za-z0-9_-]{12,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w))"
    r"|(?P<card>(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w))"
)
#: Titles and the gender they tell: m, f or neither.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "господин": "m", "Господин": "m", "κύριος": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f", "госпожа": "f", "Госпожа": "f", "κυρία": "f", "Κυρία": "f",
    "Dr": "", "Prof": "", "Professor": "",
}
PART = r"(?:[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][a-zß-öø-ÿĀ-ɏα-ωάέήίόύώςа-яё]+(?:[-'’][A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)*|[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]{2,})"
NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[  ]({PART}(?: {PART}){{0,2}})(?!\w)")
TITLE_TEXTS = [t + end for t in TITLES for end in (" ", ". ", " ")]

ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäãåæçèéêëìíîïñòóôöõøùúûüýÿœß", "ÀÁÂÄÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØÙÚÛÜÝŒ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
PLACE = {c: (a, k) for a in ALPHABETS for k, c in enumerate(a)}
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


#: Attempts within an entity's own format; exceptions that may be broadcast.
WIDE, FEW = 8, 50_000


def _keyed(key: bytes, label: str, size: int) -> int:
    return int.from_bytes(hashlib.shake_256(key + b"\0" + label.encode("utf-8", "surrogatepass")).digest(size), "big")


def permute(key: bytes, tweak: str, x: int, m: int) -> int:
    """A keyed permutation of 0 ... m - 1."""
    if m < 2:
        return x
    half = max(1, ((m - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        a, b = x >> half, x & mask
        for turn in range(8):
            a, b = b, a ^ (_keyed(key, f"{tweak}/{m}/{turn}/{b}", size) & mask)
        x = (a << half) | b
        if x < m:
            return x


def permute_text(key: bytes, tweak: str, text: str, place: dict = PLACE) -> str:
    """Each character moved within its own alphabet, all together by one permutation; others stay."""
    where = [place.get(c) for c in text]
    x, m = 0, 1
    for p in where:
        if p:
            x, m = x * len(p[0]) + p[1], m * len(p[0])
    x = permute(key, tweak + "/" + "".join(p[0][0] if p else c for c, p in zip(text, where, strict=True)), x, m)
    out = []
    for c, p in zip(reversed(text), reversed(where), strict=True):
        if p:
            x, k = divmod(x, len(p[0]))
            c = p[0][k]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that makes digits valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрстф", "greek": "βγδζκλμνπρστφ"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
ENDS = {("latin", "m"): "nrs", ("latin", "f"): "a", ("latin", ""): "lnr", ("cyrillic", "m"): "нрв", ("cyrillic", "f"): "а", ("cyrillic", ""): "лнр", ("greek", "m"): "ς", ("greek", "f"): "α", ("greek", ""): "ης"}


def script_of(word: str) -> str:
    return "cyrillic" if re.search("[А-яЁё]", word) else "greek" if re.search("[Α-ωά-ώ]", word) else "latin"


def make_name(key: bytes, label: str, word: str, gender: str, syllables: int = 3) -> str:
    """A made-up name of three syllables (or more) and an ending, in the script and letter case of word."""
    script = script_of(word)
    x = _keyed(key, f"name/{label}/{gender}/{word.casefold()}", 8 + 2 * syllables)
    out = []
    for _ in range(syllables):
        x, c = divmod(x, len(CONSONANTS[script]))
        x, v = divmod(x, len(VOWELS[script]))
        out.append(CONSONANTS[script][c] + VOWELS[script][v])
    x, c = divmod(x, len(CONSONANTS[script]))
    out.append(CONSONANTS[script][c])
    if gender != "f":
        x, v = divmod(x, len(VOWELS[script]))
        out.append(VOWELS[script][v])
    ends = ENDS[script, gender]
    name = "".join(out) + ends[x % len(ends)]
    return name.upper() if word.isupper() else name.capitalize()


@lru_cache(200_000)
def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of an entity; attempts give other ones."""
    tweak, more = f"{kind}/{attempt}", max(0, attempt + 1 - WIDE)
    if more and kind == "email":
        value = ("a" * more + "@").join(value.rsplit("@", 1))
    elif more and kind in ("secret", "iban", "phone", "ssn", "card"):
        value += "0" * more
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        reserved = re.search(r"(?:^|\.)(?:example(?:\.(?:com|net|org))?|test|invalid)$", domain.lower())
        body, dot, top = domain.rpartition(".")
        return permute_text(key, tweak, local) + "@" + (domain if reserved else permute_text(key, tweak + "/domain", body) + dot + top)
    if kind == "ip":
        a, b, c, d = map(int, value.split("."))
        x = permute(key, tweak, (a << 24) | (b << 16) | (c << 8) | d, 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "secret":
        prefix = re.match(r"(?:AKIA|ASIA|ghp_|gho_|sk-|pk-|xox[abp]-)?", value)[0]
        if prefix:
            return prefix + permute_text(key, tweak, value[len(prefix) :])
        alphabet = HEX_UPPER if re.search("[A-F]", value) else HEX_LOWER
        return permute_text(key, tweak, value, {c: (alphabet, k) for k, c in enumerate(alphabet)})
    if kind == "iban":
        bare = value.replace(" ", "")
        body = permute_text(key, tweak, bare[4:])
        number = lambda head, rest: int("".join(str(int(c, 36)) for c in rest + head))
        check = bare[2:4] if number(bare[:4], bare[4:]) % 97 != 1 else f"{98 - number(bare[:2] + '00', body) % 97:02d}"
        it = iter(bare[:2] + check + body)
        return "".join(c if c == " " else next(it) for c in value)
    if kind in ("phone", "ssn"):
        head = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        head = head[0] if head else ""
        return head + permute_text(key, tweak, value[len(head) :])
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10
        body = digits[0] + permute_text(key, tweak + digits[0], digits[1:-1])
        return _refill(value, body + str((luhn(body) + off) % 10))
    gender = {"given-m": "m", "given-f": "f"}.get(kind, "")
    return make_name(key, f"{kind}/{attempt}", value, gender, 3 + more)


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a text, in order; they do not overlap."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    if re.search("[0-9@]", text):
        out = [(m.start(), m.end(), m.lastgroup or "", m[0]) for m in NUMERIC.finditer(text)]
    if any(t in text for t in TITLE_TEXTS):
        for m in NAME.finditer(text):
            if any(a < m.end() and m.start() < b for a, b, _, _ in out):
                continue
            gender, at = TITLES[m[1]], m.start(2)
            parts = m[2].split(" ")
            for k, part in enumerate(parts):
                kind = "family" if k == len(parts) - 1 else {"m": "given-m", "f": "given-f"}.get(gender, "given")
                out.append((at, at + len(part), kind, part))
                at += len(part) + 1
        out.sort()
    return out


def replaced(text: str | None, key: bytes, exceptions: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    found = find(text)
    if not found:
        return text, found
    out, at = [], 0
    for a, b, kind, value in found:
        out += [text[at:a], surrogate(key, kind, value, exceptions.get((kind, value), 0))]
        at = b
    return "".join([*out, text[at:]]), found


def entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The distinct kind, value and first surrogate of all entities of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sorted({(k, v) for t in batch.column("text").to_pylist() for _, _, k, v in find(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([v for _, v in own], pa.string()), pa.array([surrogate(key, k, v) for k, v in own], pa.string())], ["kind", "value", "surrogate"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, value string, surrogate string").distinct()


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt of the entities whose first surrogate does not do.  found: as entities() gives, computed once."""
    group = lambda c: F.when(F.col(c).startswith("given") | (F.col(c) == "family"), "name").otherwise(F.col(c))
    found = found.select("kind", "value", "surrogate", F.lit(0).alias("attempt"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, attempts = (batch.column(c).to_pylist() for c in ("kind", "value", "attempt"))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array([surrogate(key, k, v, a + 1) for k, v, a in zip(kinds, values, attempts, strict=True)], pa.string()), pa.array([a + 1 for a in attempts], pa.int32())], ["kind", "value", "surrogate", "attempt"])

    while True:
        named = found.select("kind", F.lower("value").alias("v"), F.lower("surrogate").alias("s"), "value", "surrogate", "attempt", group("kind").alias("g"))
        shared = named.groupBy("g", "s").agg(F.min(F.struct("attempt", "v", "kind")).alias("first"), F.countDistinct("v", "kind").alias("n")).filter("n > 1").select("g", "s", "first")
        twice = named.join(shared, ["g", "s"]).filter(F.struct("attempt", "v", "kind") != F.col("first")).select("kind", "value", "surrogate", "attempt")
        real = named.join(named.select(F.col("g").alias("g2"), F.col("v").alias("v2")).distinct(), (F.col("g") == F.col("g2")) & (F.col("s") == F.col("v2"))).select("kind", "value", "surrogate", "attempt")
        bad = cut(twice.unionAll(real).distinct())
        if bad.isEmpty():
            return found.filter("attempt > 0").select("kind", "value", "attempt")
        moved = bad.mapInArrow(again, "kind string, value string, surrogate string, attempt int")
        found = cut(found.join(bad.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "surrogate", "attempt").unionAll(moved))


def _with_exceptions(docs: DataFrame, key: bytes, text_col: str, few: int = FEW):
    """docs with a column _again of the exceptions in each text, or docs as they are and all exceptions as a broadcast."""
    spark = docs.sparkSession
    known = cut(exceptions(cut(entities(docs, key, text_col)), key))
    if known.count() <= few:
        return docs, spark.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in known.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(h, k, v) for h, t in zip(batch.column("_hash").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, v in {(k, v) for _, _, k, v in find(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in own], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["_hash", "kind", "value"])

    text = F.col(text_col).cast("string")
    held = docs.select(F.xxhash64(text).alias("_hash"), text.alias("text")).mapInArrow(run, "_hash long, kind string, value string").distinct()
    of_text = held.join(known, ["kind", "value"]).groupBy("_hash").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_again"))  # texts of equal hash share their exceptions, which are by entity
    return docs.join(of_text, F.xxhash64(docs[text_col].cast("string")) == of_text["_hash"], "left").drop(of_text["_hash"]), None


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """doc_id, text (with surrogates), n_entities and spans (kind, place in the input, place in the output) for each row of docs."""
    docs, shared = _with_exceptions(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), key, "text", few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            again = batch.column("_again").to_pylist() if shared is None else [None] * batch.num_rows
            for t, own_again in zip(batch.column("text").to_pylist(), again, strict=True):
                known = shared.value if shared is not None else {(x["kind"], x["value"]): x["attempt"] for x in own_again or []}
                new, found = replaced(t, key, known)
                texts.append(new)
                own, moved = [], 0
                for a, b, kind, value in found:
                    size = len(surrogate(key, kind, value, known.get((kind, value), 0)))
                    own.append({"kind": kind, "start": a, "end": b, "new_start": a + moved, "new_end": a + moved + size})
                    moved += size - (b - a)
                spans.append(own)
            kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("new_start", pa.int64()), ("new_end", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(kind))], ["doc_id", "text", "n_entities", "spans"])

    return docs.mapInArrow(run, "doc_id long, text string, n_entities long, spans array<struct<kind: string, start: bigint, end: bigint, new_start: bigint, new_end: bigint>>")


def redact(docs: DataFrame, key: bytes, few: int = FEW) -> DataFrame:
    """docs, all columns, with surrogates in `text`."""
    with_again, shared = _with_exceptions(docs, key, "text", few)

    @F.pandas_udf("string")
    def by_all(texts):
        import pandas as pd

        return pd.Series([replaced(t, key, shared.value)[0] for t in texts], dtype=object)

    @F.pandas_udf("string")
    def by_own(texts, again):
        import pandas as pd

        return pd.Series([replaced(t, key, {tuple(x.split("\0", 1)): n for x, n in json.loads(own or "{}").items()})[0] for t, own in zip(texts, again, strict=True)], dtype=object)

    if shared is not None:
        return docs.withColumn("text", by_all("text"))
    named = F.to_json(F.map_from_entries(F.transform("_again", lambda x: F.struct(F.concat_ws("\0", x["kind"], x["value"]), x["attempt"]))))
    return with_again.withColumn("text", by_own(F.col("text"), named)).select(*docs.columns)


def corpus_key(spark) -> bytes:
    """The secret key of the corpus: spark.skein.pii.key.  Where none is set one is drawn for the session, so that nobody can invert the surrogates."""
    if not spark.conf.get("spark.skein.pii.key", None):
        spark.conf.set("spark.skein.pii.key", secrets.token_hex(32))
    return spark.conf.get("spark.skein.pii.key").encode()


def op5_pii(docs: DataFrame) -> DataFrame:
    return replace(docs, corpus_key(docs.sparkSession)).select("doc_id", "text", "n_entities", F.to_json("spans").alias("spans"))
