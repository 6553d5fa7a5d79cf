"""PII surrogates: keyed, type-consistent replacements of detected entities.

Every surrogate is a keyed permutation of the entity's own format: digits become
digits, vowels vowels, a private address a private address, a card number with
a right check digit one with a right check digit, a woman's given name another
woman's given name of the same script. A permutation gives equal entities equal
surrogates, in all documents (coreference), and distinct ones distinct
surrogates; it is a single cycle, so no entity keeps its value. Spelling does
not matter: letter case and separators are put back around the surrogate.

Before texts are rewritten, the distinct entities of all documents are checked: no
two of a type may share a surrogate, and none may keep its value or get that of
another entity of the documents (but for `SHARED` kinds, where chance gives that of
a stranger at any key). An entity for which that fails goes on along its cycle to
the next value that is no entity's and not given out; where `STEPS` values aren't
free, its form is too full, and it gets a longer one, by as many digits as it takes.
These exceptions are a table of their own, joined with the documents that hold them
(or sent along, while they are few). What finds no free value in `ROUNDS` rounds is
in the table as exhausted, with a value that is distinct but some stranger's.

Who has the key can undo the permutations, so it is the caller's and stands in no
file of this package: ``configured_key`` takes it from the session, or makes one
for the application that is kept nowhere.

Entities: e-mail addresses, phone and card numbers, IPv4 and IPv6 addresses,
social security numbers, IBANs, secrets (tokens, keys, long hexadecimal
strings), and names behind a title or with a listed given name.

A null text stays null, an empty one empty. Rows are never merged or dropped;
extra columns stay, and one named like a new column is replaced. A very long text
is rewritten whole. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import SALTS, fresh, numbered, salt, written

#: Where a session names the key, or a file that holds it (of the driver).
KEY_CONF, KEY_FILE_CONF = "spark.pressmill.pii.key", "spark.pressmill.pii.keyFile"
#: Values of an entity's cycle that are tried before its form is widened; rounds until it counts as exhausted.
STEPS, ROUNDS = 5, 24
#: Exceptions that are sent to every task; more than these are joined with the documents that hold them.
SHIPPED = 100_000
#: Entities of which another's surrogate may be the value by chance: there are too few of them, or many share one.
SHARED = ("name", "ip", "ipv6", "ssn", "phone")
#: Kinds whose values may get longer.
WIDENED = ("email", "secret", "card", "iban")

#: Titles by gender, and given names by gender and script.
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Señorita Signora госпожа г-жа".split(),
    "m": "Mr Herr Monsieur Señor Signor господин г-н".split(),
    "x": "Dr Prof".split(),
}
NAMES = {
    ("f", "latin"): "Mary Maria Anna Emma Sophie Claire Marie Julia Laura Sarah Elena Lucía Carmen Ingrid Heidi Camille Alice Emily Olivia Petra Isabel".split(),
    ("m", "latin"): "John James Peter Paul Thomas Hans Karl Pierre Jean Luis Carlos Miguel Antonio David Michael Robert Louis Stefan Jürgen Diego".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
}
#: Frequent surnames by script, which stand for each other.
NAMES |= {
    ("s", "latin"): "Smith Johnson Brown Taylor Wilson Davies Evans Walker Wright Robinson Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Martin Bernard Dubois Durand Leroy Moreau Laurent Lefebvre Garcia Fernandez Gonzalez Rodriguez Lopez Martinez Sanchez Perez Gomez Ruiz Rossi Russo Ferrari Bianchi Romano Silva Santos Oliveira".split(),
    ("s", "cyrillic"): "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров".split(),
}
_list_of = {n: group for group, names in NAMES.items() for n in names}
_given_names = [n for (kind, _), names in NAMES.items() if kind != "s" for n in names]
_given_names += [n.upper() for n in _given_names]

#: Characters that replace each other.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "ñçßšž", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщьъ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
# only secrets keep their case in the canonical form
ALPHABETS += ["AEIOU", "BCDFGHJKLMNPQRSTVWXYZ"]
_class_of = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
HEX = "0123456789abcdef"
#: What shows the kind of a secret stays.
_shown = re.compile("AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ")


@lru_cache(None)
def _block(n: int) -> dict[str, tuple[str, int]]:
    """Alphabets of the 256 characters from 256 n on that ALPHABETS lacks: those of a script (their names' first word) and category."""
    groups: dict[tuple, str] = {}
    for c in map(chr, range(n << 8, n + 1 << 8)):
        if c.isalnum() and c not in _class_of:
            turns = len(c.upper()) == 1 and c.upper().lower() == c  # letter case can be put back
            key = (unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), c.lower() == c, turns)
            groups[key] = groups.get(key, "") + c
    alone: dict[tuple, str] = {}
    for key in [k for k, g in groups.items() if len(g) == 1]:
        alone[key[1:]] = alone.get(key[1:], "") + groups.pop(key)
    return {c: (g, i) for g in (*groups.values(), *alone.values()) if len(g) > 1 for i, c in enumerate(g)}


def place_of(c: str) -> tuple[str, int] | None:
    """A character's alphabet and place in it; None if nothing can stand for it."""
    return _class_of.get(c) or (_block(ord(c) >> 8).get(c) if c > "\x7f" else None)

_title = "|".join(sorted((re.escape(t) for group in TITLES.values() for t in group), key=len, reverse=True))
_given = "|".join(_given_names)
_cap = r"[^\W\d_a-zа-яß-öø-ÿ][\w'’-]*"
#: A word for a secret, of any case, and what may follow it in the name of a variable.
_secret_word = r"""(?<![^\W_])(?i:token|secret|password|passwd|api[\ _-]?key)(?:_[A-Za-z]{1,12}){0,2}["']?"""
PATTERN = re.compile(
    r"""(?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)
    |(?P<secret>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{10,}\.[\w-]+(?:\.[\w-]+)?|[0-9a-f]{32,}|[0-9A-F]{32,})\b
        |"""
    + _secret_word
    + r"""\s*[=:]\s*["']?(?P<value>[\w+/-]{8,}))
    |(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}
        |(?=[0-9A-Fa-f:]{0,39}\d)(?=[0-9A-Fa-f:]{6,39}(?![\w:]))[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:]))
    |(?P<iban>\b[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){3,7}(?:\ ?[A-Z0-9]{1,3})?\b)
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))
    |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<phone>(?<![\w+])\+\d{1,3}[\ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[\ .-]?\d{2,4}){1,4}(?!\d)|(?:\(\d{3}\)\ ?|(?<!\w)\d{3}[\ .-])\d{3}[\ .-]\d{4}(?!\d)
        |(?<![\w.,/-])(?=0(?:[\ ./-]?\d){8,11}(?![\d-]))0\d{1,4}[\ ./-]\d{2,8}(?:[\ .-]\d{2,4}){0,4}(?![\w-]))
    |(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?:[\ -]\d{4}){2,3}(?:[\ -]\d{1,3})?|\d{4}[\ -]\d{6}[\ -]\d{5})(?![\d-]))
    |(?P<name>(?<!\w)(?:(?:"""
    + _title
    + r")\.?\ "
    + _cap
    + r"(?:\ "
    + _cap
    + r"){0,2}|(?:"
    + _given
    + r")\ "
    + _cap
    + "))",
    re.VERBOSE,
)
#: Searched one by one, as each runs fast alone: a line in which PATTERN matches has a digit or @, or a listed name or title, or what
#: begins a secret, or a run of hexadecimal letters, or a key word before = or :, or seven colons.
_has = re.compile(r"[\d@]")
_words = sorted({*_given_names, *(t for group in TITLES.values() for t in group)})
_word = re.compile("|".join(f"{c}(?:{'|'.join(re.escape(w[1:]) for w in _words if w[0] == c)})" for c in sorted({w[0] for w in _words})))
_named = re.compile(rf"(?<!\w)(?:(?:{_title})\.?|{_given})\ ")
_begins = re.compile(r"AKIA|gh[pousr]_\w{20}|xox[abprs]-|sk-[\w-]{20}|eyJ[\w-]{10}")
_letters = re.compile("[A-Fa-f]{32}")
_key_words = ("token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "api key")
_key = re.compile(_secret_word.replace("\\ ", " ") + r"\s*[=:]")
#: A key word and its value in different lines, the one match that goes on behind a line end.
_across = re.compile(_secret_word.replace("\\ ", " ") + r"(?:\s*\n\s*[=:]|\s*[=:]\s*\n)")


class Keyed:
    """Permutations under one key."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode()).digest()[:32]
        self.surrogate = lru_cache(1 << 17)(self._surrogate)

    def _rounds(self, tweak: bytes, x: int, half: int, order) -> int:
        mask = (1 << half) - 1
        left, right = x >> half, x & mask
        for r in order:
            f = hashlib.blake2b(tweak + bytes([r]) + (right if r % 2 else left).to_bytes(32), key=self.key, digest_size=32).digest()
            f = int.from_bytes(f) & mask
            if r % 2:
                left ^= f
            else:
                right ^= f
        return left << half | right

    def next(self, kind: str, x: int, n: int) -> int:
        """The number behind x < n on a keyed cycle through all n numbers."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        tweak = f"{kind}:{n}".encode()

        def walk(y: int, order) -> int:  # rounds permute a power of two; numbers from n on are passed by
            y = self._rounds(tweak, y, half, order)
            while y >= n:
                y = self._rounds(tweak, y, half, order)
            return y

        return walk((walk(x, range(6)) + 1) % n, range(5, -1, -1))

    def characters(self, kind: str, text: str, alphabets=None) -> str:
        """text (lower case) with each character replaced within its alphabet; others stay."""
        places = [(alphabets, alphabets.index(c)) if alphabets and c in alphabets else place_of(c) for c in text]
        n, x = 1, 0
        for p in places:
            if p:
                n, x = n * len(p[0]), x * len(p[0]) + p[1]
        if n == 1:
            return text
        x = self.next(f"{kind}:{''.join(p[0][0] if p else c for p, c in zip(places, text, strict=True))}", x, n)
        out = []
        for p, c in zip(reversed(places), reversed(text), strict=True):
            if p:
                x, d = divmod(x, len(p[0]))
                c = p[0][d]
            out.append(c)
        return "".join(reversed(out))

    def _name_part(self, part: str) -> str:
        if group := _list_of.get(part):
            names = NAMES[group]
            return names[self.next("given" + "".join(group), names.index(part), len(names))]
        low = part.lower()
        new = self.characters("name", low)
        while new.title() in _list_of:  # list names have list surrogates
            new = self.characters("name", new)
        return new

    def _surrogate(self, kind: str, canonical: str) -> str:
        if kind in ("card", "ssn"):
            if kind == "card":
                body, check = canonical[:-1], int(canonical[-1])
                new = self.characters(kind, body)
                return new + str((check - luhn(body) + luhn(new)) % 10)
            return self.characters(kind, canonical)
        if kind == "phone":
            keep = int(canonical[0] == "0") if canonical[0] != "+" else 2 if canonical[1] in "17" else 3
            return canonical[:keep] + self.characters(kind + canonical[:keep], canonical[keep:])
        if kind == "ip":
            o = [int(x) for x in canonical.split(".")]
            fixed, radix = next(((f, r) for test, f, r in _ranges if test(o)), (0, 256))
            if fixed:
                base = 256 ** (4 - fixed)
                x = self.next(f"ip{o[:fixed]}", int.from_bytes(bytes(o[fixed:])), base)
                return ".".join(map(str, [*o[:fixed], *x.to_bytes(4 - fixed)]))
            if radix == 16:
                x = self.next("ip172", (o[1] - 16 << 16) + (o[2] << 8) + o[3], 16 << 16)
                return ".".join(map(str, [172, 16 + (x >> 16), x >> 8 & 255, x & 255]))
            x = int.from_bytes(bytes(o))
            while True:
                x = self.next("ip", x, 1 << 32)
                if not any(test([*x.to_bytes(4)]) for test, _, _ in _ranges):
                    return ".".join(map(str, x.to_bytes(4)))
        if kind == "ipv6" or kind == "secret" and re.fullmatch("[0-9a-f]+", canonical) and not canonical.isdigit():
            return self.characters(kind, canonical, HEX)
        if kind == "secret" and (shown := _shown.match(canonical)):
            front = shown.group()
            return front + self.characters(kind + front, canonical[len(front) :])
        if kind == "iban":  # check digits as far from right as they were
            land, check, body = canonical[:2], int(canonical[2:4]), canonical[4:]
            new = self.characters(kind + land, body)
            return f"{land}{(check - iban_check(land, body) + iban_check(land, new)) % 100:02d}{new}"
        if kind == "email":
            local, _, domain = canonical.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.characters('local', local)}@{self.characters('host', host)}.{top}"
        if kind == "name":
            return " ".join(map(self._name_part, canonical.split(" ")))
        return self.characters(kind, canonical)


    def further(self, kind: str, canonical: str, attempt: int) -> tuple[str, int]:
        """The surrogate of an attempt, and the characters that it is longer: first values further along the cycle, then longer forms."""
        wide = max(0, attempt - STEPS + 1) if kind in WIDENED else 0
        new = widened(kind, canonical, wide)
        for _ in range(attempt + 1 if not wide else 1):
            new = self.surrogate(kind, new)
        return new, wide


def widened(kind: str, canonical: str, n: int) -> str:
    """An entity of the same kind, n digits longer; check digits are as right or wrong as they were."""
    more = "0" * n
    if not n:
        return canonical
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        return f"{local}{more}@{domain}"
    if kind == "card":
        body, check = canonical[:-1], int(canonical[-1])
        return body + more + str((check - luhn(body) + luhn(body + more)) % 10)
    if kind == "iban":
        land, check, body = canonical[:2], int(canonical[2:4]), canonical[4:]
        return f"{land}{(check - iban_check(land, body) + iban_check(land, body + more)) % 100:02d}{body}{more}"
    return canonical + more


_ranges = [  # address ranges that an address stays in: test, octets that stay, kind
    (lambda o: o[0] in (0, 10, 127), 1, 256),
    (lambda o: o[0] == 172 and 16 <= o[1] < 32, 0, 16),
    (lambda o: o[0] == 192 and o[1] == 168 or o[0] == 169 and o[1] == 254, 2, 256),
    (lambda o: o[0] >= 224, 1, 256),
]


def luhn(body: str) -> int:
    """The check digit of a number."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(land: str, body: str) -> int:
    """The check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97


def _parts(match: re.Match) -> tuple[str, str, str, str]:
    """(kind, what stays in front, the entity as written, its canonical form)."""
    kind, text = match.lastgroup, match.group()
    if kind == "value" or kind == "secret":
        written_as = match.group("value") or text
        return "secret", text[: len(text) - len(written_as)], written_as, written_as if not re.fullmatch("[0-9A-F]+", written_as) else written_as.lower()
    if kind == "name":
        words = text.split(" ")
        front = words.pop(0) + " " if words[0].rstrip(".") not in _list_of else ""
        return kind, front, " ".join(words), " ".join(w.title() if w.title() in _list_of else w.lower() for w in words)
    if kind == "phone":
        return kind, "", text, "+" * (text[0] == "+") + re.sub(r"\D", "", text)
    if kind == "ip":
        return kind, "", text, ".".join(str(int(x)) for x in text.split("."))
    if kind in ("card", "ssn"):
        return kind, "", text, re.sub(r"\D", "", text)
    if kind == "iban":
        return kind, "", text, text.replace(" ", "")[:2] + text.replace(" ", "")[2:].lower()
    return kind, "", text, text.lower()


def _spelled(kind: str, new: str, old: str) -> str:
    """The surrogate with the separators and the letter case of what it replaces."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in old) + "".join(digits)
    if kind == "iban":
        rest = iter(new.upper())
        return "".join(c if c == " " else next(rest) for c in old) + "".join(rest)
    if kind == "name":
        return " ".join(_cased(n, o) for n, o in zip(new.split(" "), old.split(" "), strict=True))
    if kind == "ip" or len(new) != len(old):
        return new
    return _cased(new, old)


def _cased(new: str, old: str) -> str:
    if len(new) != len(old):  # a listed name
        return new.upper() if old.isupper() and len(old) > 1 else new
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, old, strict=True))


def rewritten(text: str, each) -> str:
    """text with every entity replaced by each(kind, front, entity, canonical): PATTERN.sub, without lines that can't match."""

    def put(m):
        return each(*_parts(m))

    low = text.lower()
    keys = any(w in low for w in _key_words)
    if keys and _across.search(text):
        return PATTERN.sub(put, text)
    keys = keys and _key.search(text)
    colons, letters, begins, names = text.count(":") >= 7, _letters.search(text), _begins.search(text), _word.search(text)
    if not (keys or colons or letters or begins or names or _has.search(text)):
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if (
            _has.search(line)
            or names and _word.search(line) and _named.search(line)
            or keys and _key.search(line)
            or begins and _begins.search(line)
            or letters and _letters.search(line)
            or colons and line.count(":") >= 7
        ):
            lines[i] = PATTERN.sub(put, line)
    return "\n".join(lines)


def entities(docs: DataFrame) -> DataFrame:
    """(kind, canonical) of the distinct entities of all documents."""

    def scan(batches):
        for batch in batches:
            found: set[tuple[str, str]] = set()

            def note(kind, front, entity, canonical, found=found):
                found.add((kind, canonical))
                return front + entity

            for t in batch.column(0).to_pylist():
                rewritten(t or "", note)
            kinds, values = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "canonical"])

    return docs.select("text").mapInArrow(scan, "kind string, canonical string").distinct()


def unchanged(kind: str, canonical: str, surrogate: str) -> bool:
    """Whether an entity keeps its value though a character of it can be replaced."""
    if kind == "email":
        canonical, surrogate = canonical.rpartition(".")[0], surrogate.rpartition(".")[0]
    if kind == "secret" and (shown := _shown.match(canonical)):
        canonical, surrogate = canonical[shown.end() :], surrogate[shown.end() :]
    return canonical == surrogate and any(map(place_of, canonical))


def surrogates(found: DataFrame, key: str, attempt: int = 0) -> DataFrame:
    """(kind, canonical, surrogate, widened, same, kept): entities with what stands for them in an attempt."""

    def scan(batches):
        keyed = Keyed(key)
        for batch in batches:
            kinds, old = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [keyed.further(k, c, attempt) for k, c in zip(kinds, old, strict=True)]
            new = [m[0] for m in made]
            same = list(map(unchanged, kinds, old, new))
            kept = [o == n for o, n in zip(old, new, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(new, pa.string()), pa.array([m[1] for m in made], pa.int32()), pa.array(same, pa.bool_()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "canonical", "surrogate", "widened", "same", "kept"])

    return found.select("kind", "canonical").mapInArrow(scan, "kind string, canonical string, surrogate string, widened int, same boolean, kept boolean")


def collisions(found: DataFrame, key: str) -> DataFrame:
    """(kind, surrogate, n, taken): surrogates that several entities would share, that equal their entity, or that are another's value (taken)."""
    pairs = surrogates(found, key).select("kind", "surrogate", "same", "kept")
    none = F.lit(None).cast("boolean")
    own = found.where(~F.col("kind").isin(*SHARED)).select("kind", F.col("canonical").alias("surrogate"), none.alias("same"), none.alias("kept"))
    both = pairs.unionAll(own).groupBy("kind", "surrogate").agg(F.count("same").alias("n"), F.count_if(F.col("same").isNull()).alias("others"), F.max(F.col("same").cast("int")).alias("same"), F.count_if("kept").alias("kept"))
    # what has nothing to replace is its own surrogate, and no other's value
    taken = (F.col("same") == 1) | (F.col("others") > F.col("kept")) & (F.col("n") >= 1)
    return both.where("n > 1 OR same = 1 OR n = 1 AND others > kept").select("kind", "surrogate", "n", taken.alias("taken"))


EXCEPTION = "kind string, canonical string, surrogate string, widened int, exhausted boolean"


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """Entities whose surrogate isn't the key's own, with the one they get. found: distinct entities.

    Each round moves those that still collide to their next value and looks for it among all entities and all that is
    given out; of several that come to one value, the least keeps it.
    """
    spark = found.sparkSession
    bad = written(collisions(found, key), "collisions")
    if bad.isEmpty():
        return spark.createDataFrame([], EXCEPTION)
    at, own = ["kind", "surrogate"], ["kind", "canonical"]
    made = written(surrogates(found, key), "surrogates")
    hit = made.join(bad, at)
    stays = hit.where("NOT taken").groupBy(*at).agg(F.min("canonical").alias("canonical"))
    moving = written(hit.select(*own).distinct().join(stays.select(*own), own, "left_anti"), "moving")
    given = written(made.join(moving, own, "left_anti").select(*at), "given")
    real = found.where(~F.col("kind").isin(*SHARED)).select("kind", F.col("canonical").alias("surrogate"))
    out = spark.createDataFrame([], EXCEPTION)
    for attempt in range(1, ROUNDS + 1):
        new = written(surrogates(moving, key, attempt), "attempt")
        least = new.where(~F.col("same")).groupBy(*at).agg(F.min("canonical").alias("canonical"))
        free = least.join(real, at, "left_anti").join(given, at, "left_anti").select(*own)
        placed = written(new.join(free, own, "left_semi").select(*own, "surrogate", "widened", F.lit(False).alias("exhausted")), "placed")
        out, given = out.unionAll(placed), given.unionAll(placed.select(*at))
        moving = written(new.join(placed, own, "left_anti").select(*own), "moving")
        if moving.isEmpty():
            return written(out, "exceptions")
    # nothing free: a form of one value, or kinds that can't get longer
    return written(out.unionAll(surrogates(moving, key).select(*own, "surrogate", "widened", F.lit(True).alias("exhausted"))), "exceptions")


def configured_key(spark) -> str:
    """The session's key; where it names none, one of the application's own, which can't be had again."""
    if key := spark.conf.get(KEY_CONF, None):
        return key
    if path := spark.conf.get(KEY_FILE_CONF, None):
        with open(path, encoding="utf-8") as f:
            return f.read().strip()
    return _own_key(spark.sparkContext.applicationId)


@lru_cache(None)
def _own_key(application: str) -> str:
    return secrets.token_hex(32)


def choose_key(docs: DataFrame, key: str) -> str:
    """The key of a table's surrogates. What collides under it is told by `exceptions`."""
    if not key:
        raise ValueError("surrogates need a key")
    return f"{key}/0"


def prepared(docs: DataFrame, key: str) -> tuple[str, DataFrame]:
    """(key, exceptions) for the entities of all documents, for `replace`."""
    chosen = choose_key(docs, key)
    return chosen, exceptions(written(entities(docs), "entities"), chosen)


def _with_moved(docs: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    """docs with the exceptions that each holds. An entity of very many documents is dealt to many tasks."""
    rows, uid = numbered(docs)

    def scan(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[tuple[str, str], None] = {}

                def note(kind, front, entity, canonical, seen=seen):
                    seen[kind, canonical] = None
                    return front + entity

                rewritten(t or "", note)
                out += [(i, *x) for x in seen]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["uid", "kind", "canonical"])

    held = rows.select(uid, "text").mapInArrow(scan, "uid long, kind string, canonical string").withColumn("share", salt("uid"))
    every = moved.select("kind", "canonical", "surrogate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("share"))
    mine = held.join(every, ["kind", "canonical", "share"]).groupBy("uid").agg(F.collect_list(F.struct("kind", "canonical", "surrogate")).alias(column))
    return rows.join(mine.withColumnRenamed("uid", uid), uid, "left").drop(uid)


def replace(docs: DataFrame, key: str, count: str = "n_entities", listed: str = "entities", moved: DataFrame | None = None) -> DataFrame:
    """docs with surrogates in text, how many (long), and of which kinds (in order), under names of choice.

    moved: the exceptions to the key's surrogates, if there are any.
    """
    new = {count: T.LongType(), listed: T.ArrayType(T.StringType())}
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(k, t) for k, t in new.items())])
    sent: dict[tuple[str, str], str] = {}
    extra = None
    if moved is not None:
        few = moved.limit(SHIPPED + 1).count() <= SHIPPED
        if few:
            sent = {(r.kind, r.canonical): r.surrogate for r in moved.select("kind", "canonical", "surrogate").collect()}
        else:
            extra = fresh("_moved", docs)
            docs = _with_moved(docs, moved, extra)

    def scan(batches):
        keyed = Keyed(key)
        for batch in batches:
            texts, kinds = [], []
            of_rows = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
            for t, mine in zip(batch.column("text").to_pylist(), of_rows, strict=True):
                seen: list[str] = []
                own = {(x["kind"], x["canonical"]): x["surrogate"] for x in mine} if mine else sent

                def put(kind, front, entity, canonical, seen=seen, own=own):
                    seen.append(kind)
                    return front + _spelled(kind, own.get((kind, canonical)) or keyed.surrogate(kind, canonical), entity)

                texts.append(None if t is None else rewritten(t, put))
                kinds.append(seen)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(k) for k in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string()))], schema.names)

    return docs.mapInArrow(scan, schema)


def op7_pii(spark, sf_dir) -> DataFrame:
    """doc_id, text with surrogates, n_entities and their kinds, of whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key, moved = prepared(docs, configured_key(spark))
    return replace(docs, key, moved=moved).select("doc_id", "text", "n_entities", "entities")
