"""Personal data and secrets replaced by surrogates of the same kind and shape.

Entities are e-mail addresses, phone, card, social-security and IBAN numbers, IPv4
addresses, secrets given after a key word or in a well-known shape, and names after
a form of address, hyphens, apostrophes and particles included, wherever they stand again
in the text. An entity's canonical form (lower case, digits only ...) is what
coreference goes by: the same entity gets the same surrogate in every document and
spelling, rendered in the separators and capitals of the place.

Numbers and strings are mapped by a keyed permutation of their own format (a Feistel
network over mixed radices), so different entities of a format never share a
surrogate; names are composed from syllables by a keyed hash, matching gender and
script (Latin, Cyrillic or Greek; names in other scripts get Latin ones). A family name
is mapped by itself, and a name is the same person under any form of address. What can still collide (names among each other, and any surrogate with an
entity that occurs in the corpus) is found in Spark over the table of distinct
entities and drawn again; only these exceptions are joined back to documents.

Where a format is too full, or an entity has nothing in it that its format could map,
surrogates come from a wider format: secrets and local parts of addresses from letters
and digits of their length, then longer ones; phones from all digits of their length,
then, like card, social-security and IBAN numbers, from letters and digits; addresses
of a private block from 10.0.0.0/8; IPv4 addresses at last from the IPv6 block fd00::/8;
names get more syllables. Every entity finds a place, at any number of them.

Defined results: null text stays null and has no entity; empty texts stay; rows that
repeat get the same text; ids are not used, so missing ones do no harm; other columns
are kept, a column ``n_entities`` is replaced; no documents, no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirwise.llm.common import slices, text_or_empty
from dirwise.session import saved

#: Spark setting that holds the key where none is given (see ``corpus_key``).
KEY_SETTING = "spark.dirwise.surrogates.key"
ROUNDS = 8
#: Draws from a format; what still collides after so many is drawn from a wider one (see ``wider``).
DRAWS = 6

# Forms of address with the gender they tell (n: none).
ADDRESS = {"Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "господин": "m", "κύριος": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "госпожа": "f", "κυρία": "f", "Dr": "n", "Prof": "n"}
GIVEN = {
    ("latin", "m"): "Adrian Bruno Caspar Damian Emil Felix Gregor Hugo Ivo Julian Karsten Leo Martin Nils Oscar Paul Quentin Robert Simon Theo".split(),
    ("latin", "f"): "Alma Bianca Clara Diana Elsa Flora Greta Hanna Iris Julia Karla Lena Marta Nora Olga Paula Rosa Silvia Thea Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Олег Павел Роман Степан Тимур".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Злата Ирина Карина Лидия Мария Нина Ольга Полина Раиса София".split(),
    ("greek", "m"): "Άγγελος Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάριος Νίκος Πέτρος Σταύρος Φίλιππος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δέσποινα Ελένη Ζωή Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Σοφία".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga go ha he ho ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo wa we".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο δα δε δο γα γο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {"latin": ("ner", "lin", "mann", "berg"), "cyrillic": ("ков", "лин", "нин", "шев"), "greek": ("δης", "κης", "πος", "ρας")}

WORD = r"[^\W\d_]"
# Small words inside names, and words that are family names as well as days and months, which stay where they stand alone.
PARTICLES = "al ap bin da de del della den der di do dos du el ibn la le ten ter van von y zu".split()
DATES = frozenset("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Januar Februar März Mai Juni Juli Oktober Dezember Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag".split())
UPPERED = r"(?=[^\W\d_a-zа-яα-ω])"
NAME_PART = rf"(?:(?:{'|'.join(PARTICLES)})(?:[ \t]|[-'’]))*{UPPERED}{WORD}+(?:[-'’]{WORD}+)*"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"""|(?P<key>(?i:pass(?:word|wd|phrase)|pwd|secret|(?:api|access|auth|secret|private)[_ -]?(?:key|token)|token)["']?\s*[:=]\s*["']?)(?P<secret>[^\s"',;<>]{6,})"""
    r"|(?P<shape>\b(?:AKIA[0-9A-Z]{16}|AIza[\w-]{35}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])(?:\d{3}-\d{2}-\d{4}(?![\d-])|(?<!\d )\d{3} \d{2} \d{4}(?![ -]?\d)))"
    r"|(?P<card>(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?!-?\d)|(?<![\d-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!-?\d))"
    r"|(?P<phone>(?<![\w.])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,4})(?![\w-]))"
    rf"|(?P<title>\b(?:{'|'.join(map(re.escape, sorted(ADDRESS, key=len, reverse=True)))})\.?[ \t]+)(?P<name>{NAME_PART}(?:[ \t]{NAME_PART}){{0,2}})"
)
HINT = re.compile("[0-9@=:]")
#: What is called and not written out is no secret.
CALL = re.compile(r"[A-Za-z_$][\w.$:]*\(")
#: Well-known openings of a secret stay.
PREFIX = re.compile("(?:AKIA|AIza|gh[pousr]_|xox[abprs]-|sk-|eyJ)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def address_kind(octets: tuple[int, ...]) -> int:
    """How many leading octets name a reserved block that a surrogate must stay in; 0 for ordinary addresses."""
    a, b = octets[:2]
    if a in (0, 10, 127) or a >= 224:
        return 1
    return 2 if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 else 0


def found(text: str) -> Iterator[tuple[str, str, int, int]]:
    """kind, canonical form, start and end of every entity, in order.

    A person named after a form of address is known in the whole text: by the full
    name, and by the family name if that is no day or month.
    """
    first = list(_patterns(text))
    called: dict[str, str] = {}
    for kind, canon, start, end in first:
        if kind == "name":
            raw = text[start:end]
            called.setdefault(raw, canon)
            last = raw.replace("\t", " ").rpartition(" ")[2]
            if last != raw and len(last) > 2 and last not in DATES:
                called.setdefault(last, f"{canon[0]}|{last.casefold()}")
    if not called:
        yield from first
        return
    again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(called, key=len, reverse=True)))})(?![\w])")
    taken = [(a, b) for _, _, a, b in first]
    starts = [a for a, _ in taken]
    for m in again.finditer(text):
        at = bisect.bisect_right(starts, m.start()) - 1
        if (at < 0 or taken[at][1] <= m.start()) and (at + 1 == len(taken) or m.end() <= starts[at + 1]):
            first.append(("name", called[m.group()], *m.span()))
    yield from sorted(first, key=lambda e: e[2])


def _patterns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """What the patterns tell by themselves."""
    if not HINT.search(text) and not any(x in text for x in ADDRESS):
        return
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        raw = m.group(kind)
        start, end = m.span(kind)
        if kind == "email":
            canon = raw.lower()
        elif kind in ("secret", "shape"):
            if kind == "secret" and CALL.match(raw):
                continue
            kind, canon = "secret", raw
        elif kind == "iban":
            canon = raw.replace(" ", "")
            if len(canon) < 15 or iban_rest(canon) != 1:
                continue
        elif kind == "ip":
            octets = raw.split(".")
            if any(int(x) > 255 for x in octets):
                continue
            canon = ".".join(str(int(x)) for x in octets)
        elif kind == "name":
            canon = " ".join(raw.casefold().split())
            gender = ADDRESS[m.group("title").strip().rstrip(".")]
            canon = f"{gender}|{canon}"
        else:
            canon = re.sub(r"\D", "", raw)
            if kind == "phone":
                if not 7 <= len(canon) <= 15:
                    continue
                if len(canon) == 11 and canon[0] == "1":
                    canon = canon[1:]
            elif kind == "card" and not 13 <= len(canon) <= 19:
                continue
        yield kind, canon, start, end


def draw(key: bytes, what: str, below: int) -> int:
    size = (below.bit_length() + 7) // 8 + 8
    data = hashlib.blake2b(what.encode("utf-8", "replace"), key=key).digest()
    while len(data) < size:
        data += hashlib.blake2b(data, key=key).digest()
    return int.from_bytes(data[:size], "big") % below


def permuted(values: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the digit strings over ``radices``."""
    half = len(values) // 2

    def joined(lo: int, hi: int) -> tuple[int, int]:
        number, below = 0, 1
        for v, r in zip(values[lo:hi], radices[lo:hi], strict=True):
            number, below = number * r + v, below * r
        return number, below

    (left, left_below), (right, right_below) = joined(0, half), joined(half, len(values))
    for i in range(ROUNDS):
        if i % 2 or not half:
            right = (right + draw(key, f"{tweak}|{i}|{left}", right_below)) % right_below
        else:
            left = (left + draw(key, f"{tweak}|{i}|{right}", left_below)) % left_below
    out = []
    for number, part in ((right, radices[half:]), (left, radices[:half])):
        for r in reversed(part):
            number, v = divmod(number, r)
            out.append(v)
    return out[::-1]


LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def permuted_text(text: str, key: bytes, tweak: str, hexed: bool = False) -> str:
    """Letters and digits permuted within their classes; other characters stay. The tweak names the shape, so shapes don't meet."""
    hexed = hexed and len(text) >= 16 and set(text) <= set(HEX)
    alphabets = [HEX if hexed else next((a for a in (LOWER, UPPER, DIGITS) if c in a), None) for c in text]
    places = [i for i, a in enumerate(alphabets) if a]
    if not places:
        return text
    values = permuted([alphabets[i].index(text[i]) for i in places], [len(alphabets[i]) for i in places], key, tweak)
    out = list(text)
    for i, v in zip(places, values, strict=True):
        out[i] = alphabets[i][v]
    return "".join(out)


def walked(text: str, key: bytes, tweak: str, fits: Callable[[str], bool]) -> str:
    """Permute until the result fits; if the text itself does not, any result will do. Still a permutation of what fits."""
    must = fits(text)
    while True:
        text = permuted_text(text, key, tweak)
        if not must or fits(text):
            return text


def drawn(alphabet: str, n: int, key: bytes, what: str) -> str:
    """``n`` characters by a keyed hash."""
    data = hashlib.shake_256(key + b"|" + what.encode("utf-8", "replace")).digest(2 * n)
    return "".join(alphabet[(data[i] << 8 | data[i + 1]) % len(alphabet)] for i in range(0, 2 * n, 2))


def mappable(text: str) -> bool:
    """A permutation of ASCII letters and digits hides the text."""
    return any(c in LOWER + UPPER + DIGITS for c in text) and not any(c.isalnum() and not c.isascii() for c in text)


def wider(kind: str, canon: str, wide: int, key: bytes, what: str) -> str:
    """Surrogate in the format ``wide`` steps wider than the entity's own; names and e-mail addresses do without."""
    if kind == "secret":
        head = PREFIX.match(canon).group() if wide == 1 else ""
        return head + drawn(LOWER + UPPER + DIGITS, len(canon) - len(head) + max(wide - 2, 0), key, what)
    if kind == "ip":
        if wide == 1 and address_kind(tuple(map(int, canon.split(".")))) == 2:
            return "10." + ".".join(str(draw(key, f"{what}|{i}", 256)) for i in range(3))
        return "fd" + ":".join(drawn(HEX, 2 if i == 0 else 4, key, f"{what}|{i}") for i in range(8))
    if kind == "iban":
        rest = drawn(UPPER + DIGITS, len(canon) - 4, key, what)
        return f"{canon[:2]}{98 - iban_rest(canon[:2] + '00' + rest):02d}{rest}"
    return drawn(DIGITS if kind == "phone" and wide == 1 else UPPER + DIGITS, len(canon), key, what)


def script_of(name: str) -> str:
    return "cyrillic" if re.search("[а-яё]", name) else "greek" if re.search("[α-ωά-ώ]", name) else "latin"


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """Canonical form of an entity's surrogate; each attempt is a mapping of its own."""
    tweak, wide = f"{kind}|{attempt}", attempt // DRAWS
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        host, _, top = domain.rpartition(".")
        if wide or not mappable(local):
            local = drawn(LOWER + DIGITS, len(local) if wide < 2 else max(len(local), 6) + wide - 2, key, f"{tweak}|{canon}")
        else:
            local = permuted_text(local, key, f"{tweak}|{domain}")
        host = permuted_text(host, key, tweak) if mappable(host) else drawn(LOWER + DIGITS, len(host), key, f"{tweak}|{domain}")
        return f"{local}@{host}.{top}"
    if kind == "secret" and not mappable(canon[PREFIX.match(canon).end() :]):
        wide = max(wide, 1)
    if wide and kind != "name":
        return wider(kind, canon, wide, key, f"{tweak}|{canon}")
    if kind == "secret":
        head = PREFIX.match(canon).group()
        return head + permuted_text(canon[len(head) :], key, f"{tweak}|{head}", hexed=True)
    if kind == "ip":
        octets = tuple(map(int, canon.split(".")))
        keep = address_kind(octets)
        while True:
            octets = octets[:keep] + tuple(permuted(list(octets[keep:]), [256] * (4 - keep), key, f"{tweak}|{octets[:keep]}"))
            if address_kind(octets) == keep:
                return ".".join(map(str, octets))
    if kind == "iban":
        rest = permuted_text(canon[4:], key, f"{tweak}|{canon[:2]}")
        return f"{canon[:2]}{98 - iban_rest(canon[:2] + '00' + rest):02d}{rest}"
    if kind == "card":
        valid = luhn(canon)
        if valid:
            body = canon[0] + permuted_text(canon[1:-1], key, f"{tweak}|{canon[0]}")
            return next(body + c for c in DIGITS if luhn(body + c))
        return canon[0] + walked(canon[1:], key, f"{tweak}|{canon[0]}", lambda x: not luhn(canon[0] + x))
    if kind == "phone":
        if len(canon) == 10:
            return walked(canon, key, tweak, lambda x: x[0] > "1" and x[3] > "1")
        return canon[:2] + permuted_text(canon[2:], key, f"{tweak}|{canon[:2]}")
    if kind == "ssn":
        return walked(canon, key, tweak, lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000")
    gender, _, name = canon.partition("|")
    first, _, last = name.rpartition(" ")
    family = family_name(last, attempt, key)
    return f"{gender}|{given_name(first, name, gender, attempt, key)} {family}" if first else f"{gender}|{family}"


def family_name(name: str, attempt: int, key: bytes) -> str:
    """A family name has one surrogate, whoever bears it."""
    script, wide = script_of(name), attempt // DRAWS
    number, end = divmod(draw(key, f"family|{attempt}|{name}", 1 << 62 + 8 * wide), len(ENDINGS[script]))
    syllables, family = SYLLABLES[script], ""
    for _ in range(3 + wide):
        number, i = divmod(number, len(syllables))
        family += syllables[i]
    return family + ENDINGS[script][end]


def given_name(first: str, name: str, gender: str, attempt: int, key: bytes) -> str:
    """A listed given name, drawn for the whole name; with more draws a second one, then syllables as well."""
    script = script_of(first)
    number = draw(key, f"given|{attempt}|{name}", 1 << 62 + 8 * attempt)
    number, of = divmod(number, 2)
    given = GIVEN[script, gender if gender != "n" else "fm"[of]]
    number, i = divmod(number, len(given))
    out = given[i].casefold()
    if attempt >= DRAWS:
        number, i = divmod(number, len(given))
        out += "-" + given[i].casefold()
    for _ in range(attempt // DRAWS - 1):
        number, i = divmod(number, len(SYLLABLES[script]))
        out += SYLLABLES[script][i]
    return out


def rendered(kind: str, new: str, raw: str) -> str:
    """The surrogate in the separators and capitals of the place."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = [c for c in raw if c.isdigit() or (kind == "iban" and c.isalpha())]
        new = raw[next(i for i, c in enumerate(raw) if c.isdigit())] + new if kind == "phone" and len(chars) == len(new) + 1 else new
        fill = iter(new)
        return "".join(next(fill) if c.isdigit() or (kind == "iban" and c.isalpha()) else c for c in raw)
    if kind == "email":
        if len(new) != len(raw):
            return new.upper() if raw.isupper() else new
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, raw, strict=True))
    if kind == "name":
        new = new.partition("|")[2]
        return new.upper() if raw.isupper() and len(raw) > 2 else new.title()
    return new


def replaced(text: str, others: dict[tuple[str, str], str], key: bytes) -> tuple[str, int]:
    """The text with surrogates, and their number; ``others`` has those that are not an entity's first draw."""
    out, at, n = [], 0, 0
    for kind, canon, start, end in found(text):
        new = others.get((kind, canon)) or surrogate(kind, canon, 0, key)
        out += [text[at:start], rendered(kind, new, text[start:end])]
        at, n = end, n + 1
    return ("".join(out) + text[at:], n) if n else (text, 0)


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text_key (hash of the text), kind and canonical form of every entity, once per text."""

    def run(batches):
        for batch in slices(batches):
            rows = [(k, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in dict.fromkeys(e[:2] for e in found(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["text_key", "kind", "canon"])

    text = text_or_empty(text_col)
    return docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "text_key long, kind string, canon string")


def settled(entities: DataFrame, new: Column, real: DataFrame) -> DataFrame:
    """``entities`` (scope, canon, gender) with attempt and surrogate, drawn until none is shared in its scope or stands in ``real`` (scope, surrogate)."""
    named = saved(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", new))
    while True:  # ends: formats get wider with the draws, and the widest are never full
        first = named.groupBy("scope", "surrogate").agg(F.min("canon").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        twice = named.join(first, ["scope", "surrogate"]).where("canon <> keeper").select("scope", "canon")
        clash = saved(named.join(real, ["scope", "surrogate"], "left_semi").select("scope", "canon").union(twice).distinct())
        if not clash.limit(1).count():
            return named
        again = named.join(clash, ["scope", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", new)
        named = saved(named.join(clash, ["scope", "canon"], "left_anti").unionByName(again))


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt and surrogate of every distinct entity, without collisions.

    Names are settled without their form of address: family names among each other and clear of all
    real ones, then given names within a family. A name's gender is the one that its forms of address tell,
    none if they tell two; its surrogate is the same under all of them.
    """
    @F.pandas_udf(T.StringType())
    def plain(kind: pd.Series, canon: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, a, key) for k, c, a in zip(kind, canon, attempt, strict=True)], dtype=object)

    @F.pandas_udf(T.StringType())
    def family(canon: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([family_name(c, a, key) for c, a in zip(canon, attempt, strict=True)], dtype=object)

    @F.pandas_udf(T.StringType())
    def given(canon: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([given_name(c.rpartition(" ")[0], c, g, a, key) for c, g, a in zip(canon, gender, attempt, strict=True)], dtype=object)

    known = saved(entities.select("kind", "canon").distinct())
    rest = known.where("kind <> 'name'").select(F.col("kind").alias("scope"), "canon", F.lit(None).cast("string").alias("gender"))
    others = settled(rest, plain("scope", "canon", "attempt"), rest.select("scope", F.col("canon").alias("surrogate")))
    titled = known.where("kind = 'name'").select("canon", F.substring("canon", 1, 1).alias("told"), F.expr("substring(canon, 3)").alias("name"))
    told = F.array_except(F.collect_set("told"), F.array(F.lit("n")))
    names = saved(titled.groupBy("name").agg(told.alias("told")).select("name", F.when(F.size("told") == 1, F.get("told", F.lit(0))).otherwise("n").alias("gender"), F.substring_index("name", " ", -1).alias("family")))
    families = names.select(F.lit("").alias("scope"), F.col("family").alias("canon"), F.lit(None).cast("string").alias("gender")).distinct()
    lasts = settled(families, family("canon", "attempt"), families.select("scope", F.col("canon").alias("surrogate")))
    firsts = names.where("name <> family").select(F.col("family").alias("scope"), F.col("name").alias("canon"), "gender")
    firsts = settled(firsts, given("canon", "gender", "attempt"), firsts.select("scope", F.lit("").alias("surrogate")).limit(0))
    both = names.join(lasts.select(F.col("canon").alias("family"), F.col("attempt").alias("a"), F.col("surrogate").alias("last")), "family")
    both = both.join(firsts.select(F.col("canon").alias("name"), F.col("attempt").alias("b"), F.col("surrogate").alias("first")), "name", "left")
    full = both.select("name", (F.col("a") + F.coalesce("b", F.lit(0))).alias("attempt"), F.concat_ws(" ", "first", "last").alias("new"))
    named = titled.join(full, "name").select(F.lit("name").alias("kind"), "canon", "attempt", F.concat("told", F.lit("|"), "new").alias("surrogate"))
    return others.select(F.col("scope").alias("kind"), "canon", "attempt", "surrogate").unionByName(named)


def corpus_key(docs: DataFrame, entities: DataFrame) -> bytes:
    """The key of a run without one: the setting's, else a hash of all entities.

    The hash is the same for the same corpus and unknown to all who don't have it;
    set a key to keep surrogates alike over corpora.
    """
    told = docs.sparkSession.conf.get(KEY_SETTING, None)
    if told:
        return hashlib.sha256(told.encode()).digest()
    parts = entities.select("kind", "canon").distinct().agg(*[F.bit_xor(F.xxhash64(F.lit(i), "kind", "canon", F.md5("canon"))) for i in range(4)]).first()
    return hashlib.sha256(repr(tuple(parts)).encode()).digest()


def pseudonymised(docs: DataFrame, text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """``docs`` with entities replaced in the text column, and their number ``n_entities``; without a key that of ``corpus_key``."""
    rows = docs.drop("n_entities")
    spots = saved(mentions(rows, text_col))
    key = corpus_key(docs, spots) if key is None else key

    @F.pandas_udf(T.StringType())
    def drawn_first(kind: pd.Series, canon: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, 0, key) for k, c in zip(kind, canon, strict=True)], dtype=object)

    redrawn = assigned(spots, key).where(F.col("surrogate") != drawn_first("kind", "canon")).select("kind", "canon", "surrogate")
    own = saved(spots.join(redrawn, ["kind", "canon"]).distinct().groupBy(F.col("text_key").alias("__pii_key")).agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("__pii_redrawn")))

    @F.pandas_udf("text string, n long")
    def swap(text: pd.Series, redrawn: pd.Series) -> pd.DataFrame:
        out = [(None, 0) if t is None else replaced(t, {(r["kind"], r["canon"]): r["surrogate"] for r in rs} if rs is not None else {}, key) for t, rs in zip(text, redrawn, strict=True)]
        return pd.DataFrame(out, columns=["text", "n"])

    joined = rows.join(own, F.xxhash64(text_or_empty(text_col)) == own["__pii_key"], "left")
    done = joined.withColumn("__pii_new", swap.asNondeterministic()(F.col(text_col).cast("string"), "__pii_redrawn"))
    return done.withColumns({text_col: F.col("__pii_new.text"), "n_entities": F.col("__pii_new.n")}).select(*rows.columns, "n_entities")
