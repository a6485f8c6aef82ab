"""Operator 6: personal data replaced by keyed surrogates.

Detected entities get surrogates that a secret key derives from their normal form, so that a value has one
surrogate wherever and in whatever format it stands (coreference).  A surrogate has the type, the format (digits,
letters, separators and capitals in their places), the script and, for names, the gender of what it replaces.
All distinct values of the corpus are then checked: two values with one surrogate, or a surrogate that is itself a
value of the corpus, make the value of larger hash try again, until every value stands alone (distinctness).
Texts are read twice and never shuffled; what is carried over is the list of values that had to try again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, load, ship, with_rows, with_text_ids

#: For the query over made-up tables only: whoever knows a key can tell surrogates from it.
DEMO_KEY = b"geoframe-surrogates"
#: Values with a second try that may be broadcast; more are joined to their documents.
BROADCAST_VALUES = 100_000
TRIES = 64

# Names by script and gender (invented lists, each in alphabetical order).
NAMES = {
    ("latin", "f"): "Alice Anna Bella Carla Clara Diana Elena Emma Eva Fiona Greta Hannah Helen Ida Irene Jana Julia Karin Laura Lena Linda Lucia Maria Marta Mary Nadia Nina Olga Paula Petra Rita Rosa Sara Sonia Susan Sylvia Tanya Teresa Vera Wanda".split(),
    ("latin", "m"): "Adam Albert Anton Arthur Boris Bruno Carl Daniel David Edgar Erik Felix Frank Georg Henry Hugo Ivan Jack James John Jonas Karl Leo Louis Lukas Mark Martin Max Michael Oscar Paul Peter Robert Simon Stefan Thomas Victor Walter William Xavier".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Светлана".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Σπύρος".split(),
}
# Surrogate names are put together of these, by script: beginnings of syllables, vowels, endings by gender and of families.
SYLLABLES = {
    "latin": ("b br c d dr f g gr h j k l m n p r s st t tr v w", "a e i o u", {"f": "a ana ena ia ina elle", "m": "an en er in on us", "": "berg er ett man son well"}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф", "а е и о у", {"f": "а ина ена ия", "m": "ан ен ин ор", "": "ев ин ов ский"}),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ", "α ε ι ο", {"f": "α ινα ενη ια", "m": "ος ης ας", "": "ιδης ακης ου"}),
}
_GENDER = {n.casefold(): (script, g) for (script, g), names in NAMES.items() for n in names}
_TITLES = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "señora": "f", "dr": "", "prof": ""}
# What is looked for (fixed values).  Each search starts from a rare kind of character: @, a run of digits, a capital.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_RUN = re.compile(r"[0-9+(][0-9 .()+-]{5,}[0-9]")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: What stands before a name that its owner gives.
_CUE = re.compile(r"(?<!\w)(?i:my name is|name:|dear|signed,|regards,|sincerely,|attn:?|contact:?|je m.appelle|ich heiße|me llamo)[ \n]{1,2}")
_CAPS = "A-ZÀ-ÖØ-ÞΆΈ-ΏΑ-ΫА-ЯЁ"
_BEFORE_CAPITAL = re.compile(rf"([{_CAPS}]\w*)\.? (?=[{_CAPS}])")
_PERSON = re.compile(rf"[{_CAPS}][\w’'-]*\w(?: [{_CAPS}][\w’'-]*\w)?")
_CAPITALISED = re.compile(rf"(?<![\w’'-])[{_CAPS}][\w’'-]*\w")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, normal form) of the entities of a text, in order, in code points.

    Persons are found by a title, by a given name of the list before another capitalised word and by words with which
    people give their names; a name found so is then found in the whole text, on its own, too.  Other persons aren't found.
    Of entities that overlap the one that starts first stays, of those the longer.
    """
    out: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        local = text[start:at].lstrip(".+-_")
        domain = _DOMAIN.match(text, at + 1)
        if local and domain:
            out.append((at - len(local), domain.end(), "email", normal("email", f"{local}@{domain[0]}")))
        at = text.find("@", at + 1)
    for run in _RUN.finditer(text):
        for m in _NUMBER.finditer(text, run.start(), run.end() + 2):
            if m.lastgroup != "ip" or all(int(x) < 256 for x in m[0].split(".")):
                out.append((m.start(), m.end(), m.lastgroup, normal(m.lastgroup, m[0])))
    for m in _IBAN.finditer(text):
        if not m.start() or not text[m.start() - 1].isalnum():
            out.append((m.start(), m.end(), "iban", normal("iban", m[0])))
    for m in _BEFORE_CAPITAL.finditer(text):
        word = m[1].casefold()
        if (word in _TITLES or word in _GENDER) and (not m.start() or not text[m.start() - 1].isalnum()):
            person = _PERSON.match(text, m.end() if word in _TITLES else m.start())
            if person:
                out += _person(person[0], person.start(), _TITLES.get(word, ""))
    for m in _CUE.finditer(text):
        person = _PERSON.match(text, m.end())
        if person and " " in person[0]:
            out += _person(person[0], person.start(), "")
    names = {}
    for a, b, kind, norm in out:
        if kind in ("given", "family"):
            names.setdefault(text[a:b].casefold(), (kind, norm))
    if names:
        out += [(m.start(), m.end(), *names[w]) for m in _CAPITALISED.finditer(text) if (w := m[0].casefold()) in names]
    if len(out) < 2:
        return out
    kept: list[tuple[int, int, str, str]] = []
    for e in sorted(out, key=lambda e: (e[0], -e[1])):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def _person(words: str, at: int, gender: str) -> list[tuple[int, int, str, str]]:
    """The given and the family name; a lone name after a title is a family name."""
    out, parts = [], words.split(" ")
    for i, w in enumerate(parts):
        if i + 1 < len(parts) or _GENDER.get(w.casefold()):
            g = (_GENDER.get(w.casefold()) or (script_of(w), gender or "m"))[1]
            out.append((at, at + len(w), "given", f"{g}:{w.casefold()}"))
        else:
            out.append((at, at + len(w), "family", w.casefold()))
        at += len(w) + 1
    return out


def normal(kind: str, value: str) -> str:
    """What makes two mentions one entity."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in value if c.isdigit())[-10 if kind == "phone" else 0 :]
    return value.replace(" ", "") if kind == "iban" else value


def _stream(key: bytes, kind: str, norm: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}\0{norm}\0{attempt}\0{block}".encode("utf-8", "surrogatepass"), hashlib.sha256)
        block += 1


def _same_shape(value: str, s: Iterator[int]) -> str:
    """Digits, small and capital letters by others of their kind; marks stay."""
    return "".join(_DIGITS[next(s) % 10] if c in _DIGITS else _LOWER[next(s) % 26] if c in _LOWER else _UPPER[next(s) % 26] if c in _UPPER else c for c in value)


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The normal form of the surrogate."""
    s = _stream(key, kind, norm, attempt)
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        *labels, top = domain.split(".")
        # each domain keeps its surrogate in all addresses and below all hosts
        labels = [_same_shape(x, _stream(key, "domain", ".".join([*labels[i:], top]), 0)) for i, x in enumerate(labels)]
        return f"{_same_shape(local, s)}@{'.'.join([*labels, top])}"
    if kind == "ip":
        return ".".join(str(1 + next(s) % 254) for _ in range(4))
    if kind == "given":
        return f"{norm[0]}:{_name(norm[2:], norm[0], s, attempt)}"
    if kind == "family":
        return _name(norm, "", s, attempt)
    if kind == "iban":
        return norm[:2] + _same_shape(norm[2:], s)
    out = _same_shape(norm, s)
    if kind == "card" and luhn(norm):
        out = next(out[:-1] + d for d in _DIGITS if luhn(out[:-1] + d))
    return out


def _name(word: str, gender: str, s: Iterator[int], attempt: int) -> str:
    """As many parts, joined by a hyphen, as the name has; later tries take longer ones, so that there are always enough."""
    starts, vowels, ends = SYLLABLES[script_of(word)]
    starts, vowels, ends = starts.split(), vowels.split(), ends[gender].split()
    take = lambda of: of[(next(s) << 8 | next(s)) % len(of)]
    return "-".join("".join(take(starts) + take(vowels) for _ in range(1 + attempt // 4)) + take(starts) + take(ends) for _ in word.split("-"))


def render(kind: str, value: str, norm: str, new: str) -> str:
    """The surrogate in the format of one mention."""
    if kind in ("phone", "card", "ssn"):
        digits, gap = iter(new), sum(c.isdigit() for c in value) - len(new)
        out = []
        for c in value:
            if c.isdigit() and gap > 0:  # a country code before the number that makes the entity stays
                gap -= 1
            elif c.isdigit():
                c = next(digits)
            out.append(c)
        return "".join(out)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in value)
    if kind == "email":
        return "".join(n.upper() if i < len(value) and value[i].isupper() else n for i, n in enumerate(new))
    if kind in ("given", "family"):
        word = new[2:] if kind == "given" else new
        return word.upper() if value.isupper() else "-".join(w.capitalize() for w in word.split("-"))
    return new


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int], known: dict) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with surrogates, spans of what was replaced); known caches surrogates."""
    out, spans, at = [], [], 0
    for a, b, kind, norm in find(text):
        new = known.get((kind, norm))
        if new is None:
            if len(known) > 200_000:
                known.clear()
            new = known[kind, norm] = surrogate(key, kind, norm, attempts.get((kind, norm), 0))
        out += [text[at:a], render(kind, text[a:b], norm, new)]
        spans.append((a, b, kind))
        at = b
    return "".join([*out, text[at:]]), spans


def entities(rows: DataFrame) -> DataFrame:
    """kind, norm of every distinct entity of rows (text); a task sends each of its values once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {(kind, norm) for t in b["text"] if t for _, _, kind, norm in find(t)}
            yield pd.DataFrame(sorted(seen), columns=["kind", "norm"])

    return rows.select("text").mapInPandas(run, "kind string, norm string").distinct()


def second_tries(found: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, attempt (over 0) of the values whose first surrogates clash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(new=[surrogate(key, k, n, a) for k, n, a in zip(b["kind"], b["norm"], b["attempt"])])

    now = cut(found.withColumn("attempt", F.lit(0)), "entities")
    for _ in range(TRIES):
        tried = cut(now.mapInPandas(run, "kind string, norm string, attempt int, new string"), "surrogates")
        # of the values with one surrogate that of least attempt, then of least hash, stays; none may be a value of the corpus
        order = F.struct("attempt", F.xxhash64("kind", "norm"), "norm")
        stays = tried.groupBy("kind", "new").agg(F.min(order).alias("m"), F.count("*").alias("c"))
        real = found.select(F.col("kind").alias("k2"), F.col("norm").alias("real"))
        clash = stays.join(real, (F.col("kind") == F.col("k2")) & (F.col("new") == F.col("real")), "left").where("c > 1 or real is not null").select("kind", "new", F.col("m.norm").alias("first"), F.col("real").isNotNull().alias("taken"))
        bad = tried.join(clash, ["kind", "new"]).where("taken or norm <> first").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        bad = cut(bad, "clashes")
        if bad.isEmpty():
            return now.where("attempt > 0")
        now = cut(now.join(bad.select("kind", "norm", F.col("attempt").alias("again")), ["kind", "norm"], "left").select("kind", "norm", F.coalesce("again", "attempt").alias("attempt")), "entities")
    raise RuntimeError(f"surrogates still clash after {TRIES} tries")


def pseudonymise(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, spans (start:stop:kind in the old text) for every row of docs.

    Null text stays null, without entities; repeated rows get equal results; an empty table gives an empty one; texts of any
    length are read whole; other columns aren't read.  key is secret: it decides all surrogates.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = with_rows(docs, doc_id=id_col, text=text_col)
    again = cut(second_tries(cut(entities(rows), "entities"), key), "tries")
    few = again.count() <= broadcast_values
    shared = spark.sparkContext.broadcast({(r["kind"], r["norm"]): r["attempt"] for r in again.collect()} if few else {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            out = []
            for i, text in enumerate(b["text"]):
                if text is None:
                    out.append((None, 0, ""))
                    continue
                own = {(k, n): a for k, n, a in zip(b["kinds"].iloc[i], b["norms"].iloc[i], b["attempts"].iloc[i])} if not few and b["kinds"].iloc[i] is not None else shared.value
                new, spans = replace(text, key, own, known if few else {})
                out.append((new, len(spans), ",".join(f"{a}:{z}:{k}" for a, z, k in spans)))
            text, n, spans = map(list, zip(*out)) if out else ([], [], [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": text, "n_entities": n, "spans": spans})

    if not few:  # too many for each worker: send each document the tries of its own values

        def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [(f, r, k, n) for f, r, t in zip(b["fid"], b["rix"], b["text"]) if t for k, n in {(k, n) for _, _, k, n in find(t)}]
                yield pd.DataFrame(got, columns=["fid", "rix", "kind", "norm"])

        own = rows.mapInPandas(mentions, "fid long, rix long, kind string, norm string").join(again, ["kind", "norm"]).groupBy(*ROW).agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("x"))
        own = own.select(*ROW, F.col("x.kind").alias("kinds"), F.col("x.norm").alias("norms"), F.col("x.attempt").alias("attempts"))
        rows = rows.join(own, ROW, "left")
    return with_text_ids(rows, lambda d: d.mapInPandas(run, "doc_id string, text string, n_entities long, spans string"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pseudonymise(load(spark, sf_dir, "documents"), key=DEMO_KEY)
