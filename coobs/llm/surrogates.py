"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Mentions are found per text and reduced to an entity: type and canonical form.  A keyed hash of
the entity drives a generator that keeps what the form shows (digits stay digits, letters stay
letters of their script and case, separators, lengths, check digits, country and network prefixes
and the gender of an honorific stay).  Equal entities get equal surrogates everywhere; within a text, later
shortened, re-titled and bare mentions of a person belong to the person named before.  Over all
distinct entities the surrogates are checked: one that another entity already has, or that is itself a
real entity of the corpus, is drawn again until none collides, so distinct entities stay distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coobs.llm.tables import cut_lineage, digest

# Honorifics and the gender they tell, and names to draw from per gender and script.
GENDER = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Г-н": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Mlle": "f", "Madame": "f", "Señora": "f", "Sra": "f", "Г-жа": "f", "Dr": "n"}
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noel Oscar Paul Robin Simon Thomas Victor".split(),
    ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Vera".split(),
    ("n", "latin"): "Alex Charlie Dana Eden Jamie Jordan Kim Lee Morgan Noa Quinn Robin Sam Sascha Taylor".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Григорий Денис Егор Иван Кирилл Лев Максим".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лариса Мария".split(),
    ("n", "cyrillic"): "Саша Женя Валя Никита Слава".split(),
}
SURNAME = {
    "latin": "Abel Barnett Castell Dorn Ellis Fabre Garner Holm Ibarra Jansen Keller Lund Marin Norden Ortega Palmer Quist Renner Soler Thorn Ulrich Vidal Wagner Young Zeller".split(),
    "cyrillic": "Абрамов Белов Воронов Гусев Донцов Ершов Жуков Зимин Ильин Котов Лебедев Минин".split(),
}
SYLLABLE = {"latin": "an bel cor den el far gan hol is jor kam lin mar nor ol per ron sel tan vor".split(), "cyrillic": "ан бор вел гор дин ер зор ин кам лан мир нов ол пет ров".split()}

# Words in small letters inside family names.
PARTICLES = frozenset("da de del della den der di do dos du el la le van vom von y zu де фон".split())
ALPHABET = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}

SECRET = "password|passwd|pwd|secret|token|api[_-]?key"
HONORIFIC = "|".join(sorted(map(re.escape, GENDER), key=len, reverse=True))
#: A text without any of these holds no entity; spares most texts the Python pass.  Every pattern needs one
#: of them.  Read by Java, whose digits and word bounds differ: unassigned characters count as digits here.
#: The looks ahead at first letters change nothing but the time.
MAYBE = (
    rf"[@\p{{Nd}}\p{{Cn}}]|AKIA|ASIA|(?=[PpSs\u017fTtAa][AaWwEeOoPp])(?iu:{SECRET})"
    rf"|(?=[{''.join(sorted({h[0] for h in GENDER}))}])(?:{HONORIFIC})(?![a-z])"
)

# An apostrophe is part of a name unless an ending like 's follows; initials may come before any name.
NAME = r"[^\W\d_](?:(?:['’](?!(?:s|S|d|m|t|ll|re|ve)\b))?[^\W\d_])+"
INITIAL = r"-?[^\W\d_]\. ?"
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])")),
    ("credential", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("credential", re.compile(rf"(?i)(?:{SECRET})[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{{6,}})")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.])\+\d{8,14}(?!\w)")),
    ("person", re.compile(rf"\b(?:{HONORIFIC})\.?\s+((?:[A-ZÀ-ÖØ-ÞА-ЯЁ] )?(?:{INITIAL})*{NAME}(?:[ -](?:{INITIAL})*{NAME}){{0,2}})")),
]


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def only_digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


@lru_cache(maxsize=1 << 14)
def script_of(s: str) -> str:
    """Script of the first letter."""
    first = next((c for c in s if c.isalpha()), "a")
    return unicodedata.name(first, "OTHER").split()[0].lower()


@lru_cache(maxsize=1 << 14)
def alphabet(c: str) -> str:
    """Lower-case letters to draw from for a letter of its script; those around it where none are listed."""
    if (script := script_of(c)) in ALPHABET:
        return ALPHABET[script]
    block, lower = ord(c) & ~0x7F, c.lower()
    near = (chr(x) for x in range(block, block + 0x80))
    return "".join(x for x in near if x.isalpha() and script_of(x) == script and x.lower() == x and x.isupper() == lower.isupper()) or lower


def canonical(kind: str, text: str, before: str = "") -> str | None:
    """One form for all spellings of an entity; None if the text is no such entity."""
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "card":
        d = only_digits(text)
        return d if luhn(d) == 0 and len(set(d)) > 1 else None
    if kind == "iban":
        s = text.replace(" ", "")
        return s if len(s) >= 15 and mod97(s) == 1 else None
    if kind in ("ssn", "phone"):
        return ("+" if text.startswith("+") else "") + only_digits(text)
    if kind == "person":
        words = text.split()
        # a word in small letters ends the name, unless it links family names
        words = words[: next((i for i, w in enumerate(words) if w[:1].islower() and w not in PARTICLES), len(words))]
        while words and not words[-1][:1].isupper():
            words.pop()
        if not words or not words[0][:1].isupper() or not re.search(NAME, " ".join(words)):
            return None
        return f"{GENDER[re.match(r'[\w-]+', before)[0]]}|{' '.join(words).casefold()}"
    # a masked secret, without letters and digits, tells nothing
    return text if any(c.isalnum() for c in text) else None


def fits(a: list[str], b: list[str]) -> bool:
    """May these be the first names of one person?  One may be missing, or an initial of the other."""
    return all(x == y or (min(len(x.rstrip(".")), len(y.rstrip("."))) == 1 and x[0] == y[0]) for x, y in zip(a, b))


class Person:
    """A person of a text, as far as the mentions so far tell."""

    def __init__(self, gender: str, words: list[str]):
        self.gender, self.given, self.surname, self.spans = gender, words[:-1], words[-1], []

    def is_same(self, gender: str, words: list[str]) -> bool:
        return words[-1] == self.surname and ("n" in (gender, self.gender) or gender == self.gender) and fits(self.given, words[:-1])

    def learn(self, gender: str, words: list[str]) -> None:
        self.gender = gender if self.gender == "n" else self.gender
        self.given = max(self.given, words[:-1], key=lambda w: (len(w), len("".join(w))))

    @property
    def form(self) -> str:
        return f"{self.gender}|{' '.join([*self.given, self.surname])}"


def resolved(text: str, titled: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Mentions of persons with one form per person of the text.

    ``titled`` are those after an honorific.  A mention joins the latest person of the same surname
    whose gender and first names agree with it or are open; later bare mentions of a full name or a
    surname, spelled as before, belong to the latest person it was used for.
    """
    people: list[Person] = []
    spelled: dict[str, list[tuple[int, Person]]] = {}
    for a, b, form in titled:
        gender, _, name = form.partition("|")
        words = name.split()
        person = next((p for p in reversed(people) if p.is_same(gender, words)), None)
        if person is None:
            people.append(person := Person(gender, words))
        person.learn(gender, words)
        person.spans.append((a, b))
        last = text[a:b].split()[-1]
        if len(last) > 2:
            spelled.setdefault(last, []).append((a, person))
        spelled.setdefault(" ".join(text[a:b].split()), []).append((a, person))
    if not people:
        return []
    taken = sorted(taken)
    starts = [x for x, _ in taken]
    names = sorted((n for n in spelled if len(n) > 2), key=lambda n: (-len(n), n))
    bare = re.compile(rf"(?<![\w'’-])(?:{'|'.join(map(re.escape, names))})(?![\w-]|['’]\w\w)") if names else None
    for m in bare.finditer(text, titled[0][0]) if bare else ():
        i = bisect_right(starts, m.start())
        if (i and taken[i - 1][1] > m.start()) or (i < len(taken) and taken[i][0] < m.end()):
            continue
        for name in (m[0], m[0].split()[-1]):  # where a full name comes up later only, the surname may be known
            uses = spelled.get(name, [])
            if k := bisect_right([a for a, _ in uses], m.start()):
                uses[k - 1][1].spans.append((m.end() - len(name), m.end()))
                break
    return [(a, b, "person", p.form) for p in people for a, b in p.spans]


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical) of the entities of a text; earlier patterns win overlaps."""
    found, taken, titled = [], [], []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            group = 1 if m.lastindex else 0
            a, b = m.span(group)
            form = canonical(kind, m[group], m[0])
            if form is None:
                continue
            if kind == "person":
                b = a + len(m[group].rstrip()) if len(form.split("|")[1].split()) == len(m[group].split()) else a + len(" ".join(m[group].split()[: len(form.split("|")[1].split())]))
            i = bisect_right(taken, (a, b))
            if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                continue
            taken.insert(i, (a, b))
            if kind == "person":
                titled.append((a, b, form))
            else:
                found.append((a, b, kind, form))
    return sorted(found + resolved(text, titled, taken))


class Stream:
    """Numbers from a keyed hash of an entity."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.pool = key, "\x00".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n

    def like(self, s: str) -> str:
        """Letters for letters, digits for digits, the rest unchanged; hexadecimal stays so."""
        if re.fullmatch("[0-9a-f]{8,}", s) and not s.isdigit():
            return "".join("0123456789abcdef"[self.below(16)] for _ in s)
        out = []
        for c in s:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                base = alphabet(c)
                x = base[self.below(len(base))]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def name_like(r: Stream, name: str, gender: str) -> list[str]:
    """Words of a name of the same shape: hyphens, apostrophes and initials stay where they are."""
    words, out = name.split(), []
    for i, word in enumerate(words):
        parts = []
        for run in re.findall(r"[^\W\d_]+|[\W\d_]+", word):
            script = script_of(run)
            pool = SURNAME.get(script) if i == len(words) - 1 or i else GIVEN.get((gender, script))
            if not run.isalpha():
                parts.append(run)
            elif len(run) == 1 or pool is None:
                parts.append(r.like(run))
            else:
                parts.append(pool[r.below(len(pool))].casefold())
        out.append("".join(parts))
    return out


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """Canonical form of the replacement.  The domain widens with the attempts, so that the search for a
    free one ends whatever is taken."""
    r = Stream(key, kind, form, str(attempt))
    wider = "".join(str(r.below(10)) for _ in range(attempt // 8))
    if kind == "email":
        local, _, domain = form.rpartition("@")
        labels = domain.split(".")
        fixed = 3 if len(labels) > 2 and labels[-2] == "example" else 2
        d = Stream(key, "domain", domain)  # addresses of one domain stay together
        host = [d.like(x) for x in labels[: max(len(labels) - fixed + 1, 1)]] + labels[max(len(labels) - fixed + 1, 1) :]
        return r.like(local) + wider + "@" + ".".join(host)
    if kind == "ip":
        if attempt >= 32:  # an address of the range for examples, once those of four numbers are used up
            return "2001:db8:" + ":".join(f"{r.below(1 << 16):x}" for _ in range(6))
        first = r.below(222) + 1
        return ".".join(map(str, [first + (first >= 127), r.below(256), r.below(256), r.below(254) + 1]))
    if kind == "card":
        body = form[0] + "".join(str(r.below(10)) for _ in form[1:-1]) + wider
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "iban":
        body = r.like(form[4:]) + wider
        return f"{form[:2]}{98 - mod97(form[:2] + '00' + body):02d}{body}"
    if kind == "ssn":
        return f"{r.below(665) + 1:03d}{r.below(99) + 1:02d}{r.below(9999) + 1:04d}{wider}"
    if kind == "phone":
        plus, digits = form[:1] == "+", form.lstrip("+")
        keep = max(len(digits) - 10, 0)  # a country code stays
        rest = [str(r.below(8) + 2)] + [str(r.below(10)) for _ in digits[keep + 1 :]]
        if len(rest) == 10:
            rest[3] = str(r.below(8) + 2)
        return ("+" if plus else "") + digits[:keep] + "".join(rest) + wider
    if kind == "person":
        gender, _, name = form.partition("|")
        made = name_like(r, name, gender)
        script = script_of(name)
        for _ in range(attempt // 2):
            made[-1] += SYLLABLE[script][r.below(len(SYLLABLE[script]))] if script in SYLLABLE else r.like(name[-1] if name[-1].isalpha() else "a")
        return f"{gender}|{' '.join(made).casefold()}"
    prefix = 4 if re.match("AKIA|ASIA", form) else 0
    return form[:prefix] + r.like(form[prefix:]) + "".join(r.like("a") for _ in range(attempt // 4))


def rendered(kind: str, mention: str, made: str) -> str:
    """The surrogate in the format of the mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(made.lstrip("+"))
        return "".join(next(chars, "") if c.isalnum() else c for c in mention) + "".join(chars)
    if kind == "person":
        shown, words = mention.split(), made.split("|")[1].split()
        shown, out = shown[-len(words) :], []
        for like, word in zip(shown, words[-len(shown) :]):  # a shorter mention shows the last words
            if like.endswith(".") and len(like) == 2:
                out.append(word[:1].upper() + ".")
            elif like.isupper() and len(like) > 1:
                out.append(word.upper())
            else:
                out.append(word if like.islower() else re.sub(r"[^\W\d_]+", lambda m: m[0][:1].upper() + m[0][1:], word))
        return " ".join(out)
    if kind == "email":
        return made.upper() if mention.isupper() else made
    return made


MENTIONS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("form", pa.string())]))


def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {}
        for d, text in zip(batch.column("digest").to_pylist(), batch.column("_text").to_pylist()):
            if d not in seen and (found := mentions(text)):
                seen[d] = [dict(zip(("start", "end", "kind", "form"), m)) for m in found]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), MENTIONS)], names=["digest", "mentions"])


def draw(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "form", "attempt")))
        made = pa.array([surrogate(key, *row) for row in rows], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "made"])


def replace(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, counts = [], []
        for text, edits in zip(batch.column("_text").to_pylist(), batch.column("edits").to_pylist()):
            parts, at = [], 0
            for e in sorted(edits or (), key=lambda e: e["start"]):
                parts += [text[at : e["start"]], rendered(e["kind"], text[e["start"] : e["end"]], e["made"])]
                at = e["end"]
            out.append(None if text is None else "".join([*parts, text[at:]]))
            counts.append(len(edits or ()))
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.string()), pa.array(counts, pa.int64())], names=[*names, "_text", "_n"])


def mapping(entities: DataFrame, key: bytes) -> DataFrame:
    """(``kind``, ``form``, ``made``) with distinct surrogates, none of them a real entity."""
    entities = cut_lineage(entities.select("kind", "form").distinct(), "entities")
    real = entities.select("kind", F.col("form").alias("made"))
    done, pending, attempt = None, entities, 0
    while True:
        drawn = pending.withColumn("attempt", F.lit(attempt)).mapInArrow(lambda it: draw(it, key), "kind string, form string, attempt int, made string").drop("attempt")
        drawn = cut_lineage(drawn, "surrogates_drawn")
        free = drawn.join(real, ["kind", "made"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "made"], "left_anti")
        won = cut_lineage(free.groupBy("kind", "made").agg(F.min("form").alias("form")).select("kind", "form", "made"), "surrogates")
        done = won if done is None else cut_lineage(done.union(won), "surrogates")
        pending = cut_lineage(drawn.join(won, ["kind", "form"], "left_anti").select("kind", "form"), "surrogates_pending")
        if pending.isEmpty():
            return done
        attempt += 1


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced; ``count`` names a column for how many.

    Null and empty texts stay as they are; repeated texts change alike; an empty table stays
    empty; other columns pass through, but one named like ``count`` is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, count)]
    names = [f"_c{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("_text"))
    maybe = F.coalesce(F.col("_text").rlike(MAYBE), F.lit(False))
    suspect = given.where(maybe).withColumn("digest", digest("_text"))
    found = suspect.select("digest", "_text").mapInArrow(detect, "digest binary, mentions array<struct<start:int,end:int,kind:string,form:string>>")
    found = cut_lineage(found.groupBy("digest").agg(F.first("mentions").alias("mentions")), "mentions")
    single = found.select("digest", F.explode("mentions").alias("m")).select("digest", "m.*")
    made = mapping(single, key)
    edits = single.join(made, ["kind", "form"]).groupBy("digest").agg(F.collect_list(F.struct("start", "end", "kind", "made")).alias("edits"))
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema if f.name in names)
    changed = suspect.join(edits, "digest", "left").mapInArrow(lambda it: replace(it, names), f"{shape}_text string, _n bigint")
    whole = given.where(~maybe).withColumn("_n", F.lit(0).cast("bigint")).unionByName(changed)
    order = {**dict(zip(keep, names)), text: "_text"}
    return whole.select(*[F.col(order[c]).alias(c) for c in docs.columns if c in order], *([F.col("_n").alias(count)] if count else []))
