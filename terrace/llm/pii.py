"""Personal data replaced by keyed surrogates.

1. Detection. Patterns find e-mail addresses, IP addresses, card-like numbers,
   phone and social security numbers, IBANs, secrets and personal names.
2. Assignment. Each distinct entity gets a surrogate from HMAC-SHA256 under a
   secret key: digits become digits, letters letters of the same script, card
   numbers keep their brand digit and whether their check digit holds, IBANs
   their country and a right check sum, given names their gender. Candidates are
   then compared over the whole corpus: of two entities with one surrogate, and
   of a surrogate that is itself an entity of the corpus, the loser draws again,
   round after round, until no collision is left. So different entities stay
   different, and the same entity has the same surrogate wherever it stands.
3. Replacement. Each mention is rewritten with its own separators and case.

A cheap test clears most documents before any Python runs. Only entities are
shuffled; texts stay where they are while the texts with entities are few, and
are joined with their entities by a shuffle beyond that. The table of entities is
never collected or broadcast.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, free_name, kept_in_worker, slices, stage, unstage

#: Rounds of drawing, at most; a kind whose space is used up would draw for ever.
MOST_ROUNDS = 200

#: Given names by script and gender, and titles by the gender they tell.
GIVEN = {
    ("latin", "f"): "Alice Anna Camille Carla Charlotte Claire Elena Emily Emma Greta Hannah Helen Ines Isabel Jane Julia Laura Lucia Maria Marie Martha Nina Olivia Paula Sarah Sofia Sophie Susan Teresa Ursula".split(),
    ("latin", "m"): "Adam Albert Anton Bernard Carlos Charles Daniel David Diego Edward Felix George Hans Henri Henry Jack James Javier John Karl Louis Lukas Manuel Michael Oliver Pablo Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Дмитрий Иван Михаил Николай Сергей".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Sra Señora".split(), "m": "Mr Herr Monsieur Sr Señor".split(), "x": "Dr Prof".split()}
ALL_TITLES = {title for titles in TITLES.values() for title in titles}
#: Syllables of which surrogate surnames are made.
SYLLABLES = {"latin": "bar ben cor dal den fer gan hol jor kel lan mar nor pel ros sal tor ver wil zan".split(), "cyrillic": "бар вел гор дан зор кал лев мар нов пет рос сав тим чер шам яр".split()}
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")

GENDER = {name.lower(): key for key, names in GIVEN.items() for name in names}
JUNK = r"[^\w\n]"


def ranges(kinds: set[str]) -> str:
    """What stands between the brackets of a pattern for the characters of these Unicode categories."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)) in kinds
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


#: What a name starts with: any letter but a lower-case one, in any script; in Java, also characters newer than its tables.
UPPER, JAVA_UPPER = ranges({"Lu", "Lt", "Lm", "Lo"}), r"\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{Cn}"
CAPITAL = rf"(?:[{UPPER}][^\W\d_]*(?:['’-][^\W\d_]+)*)"
#: Country codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: What may stand between two digits of a phone number.
GAP = r"(?:[ \u00a0\u202f./-]|[ .-]?\(|\)[ ./-]?)?"
NATIONAL = re.compile(rf"(?<![\w+/=&#])(?<!\d[.,])(?<!\w-)\(?\d(?:{GAP}\d){{6,14}}(?!-?\w|,\d)")
#: National numbers' shape, but dates, years, decimal fractions or grouped thousands.
NO_PHONE = re.compile(
    r"(?:1\d|20)\d\d([-./])[01]?\d\1[0-3]?\d(?!\d)|[0-3]?\d([-./])[0-3]?\d\2(?:1\d|20)\d\d(?!\d)"
    r"|(?:(?:1\d|20)\d\d[ ./-])+(?:1\d|20)\d\d$|\d+\.\d+$|[1-9]\d?([ .\u00a0\u202f])\d{3}(?:\3\d{3})*$"
)
#: Words beside which digits without separators are a phone number.
CALL = re.compile(r"(?i)(?<!\w)(?:tel|telephone|telefon|teléfono|téléphone|tél|phone|mobile|mobil|móvil|portable|handy|cell|call|fax|whatsapp|sms|dial|ring|rufnummer|anruf|appelez|llame)[\w.]{0,3}[:#]?(?: (?:me|us|at|on|no|nr|number|unter|au|al|is|number is))*[.:]? ?$")
#: How keys of well-known services start; the start stays.
KEY_START = re.compile(r"a[ks]ia|gh[opsur]_|sk-|xox[abprs]-|aiza")
#: Roles beside which, and verbs before which, two capitalised words are a person.
ROLES = re.compile(r"(?i)(?<!\w)(?:name|author|autor|auteur|editor|director|direktor|directeur|president|präsident|professor|profesor|doctor|doktor|docteur|manager|colleague|kollege|collègue|colega|patient|patiente|paciente|customer|kunde|cliente?|contact|kontakt|contacto|signed|sincerely|regards|dear|attn|attorney|senator|captain|minister|ministre|ministro|teacher|lehrer|lawyer|friend|freund|amie?|amigo|neighbour|neighbor|brother|sister|von|by)[:,]? $")
VERBS = re.compile(r" (?:said|says|wrote|writes|told|asked|replied|answered|lives|works|met|sagte|sagt|schrieb|fragte|antwortete|wohnt|arbeitet|dit|écrit|répond|habite|travaille|dijo|dice|escribe|vive|trabaja|respondió)(?!\w)")
PATTERNS = [
    ("email", "@", re.compile(r"(?<![\w.+-])[\w][\w.+-]*@[\w-]+(?:\.[\w-]+)+")),
    ("iban", "0", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("secret", "", re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])")),
    ("phone", "0", re.compile(rf"(?<!\w)\+\d{{1,3}}{JUNK}{{1,8}}\(?\d{{2,4}}\)?{JUNK}{{1,8}}\d{{3}}{JUNK}{{1,5}}\d{{4}}(?!\w)|(?<![\w(])\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\w)")),
    ("phone", "0", re.compile(rf"(?<![\w+])\+\(?\d(?:{GAP}\d){{6,14}}(?!\w)")),
    ("ipv6", ":", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")),
    ("ip", "0", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")),
    ("card", "0", re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("ssn", "0", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("secret", "", re.compile(r"(?<![0-9A-Za-z])(?:A[KS]IA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z])")),
    ("assigned", "=:", re.compile(r"(?i)(?<!\w)(?:token|secret|password|passwd|api[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<value>[\w+/-]{12,})")),
]
TITLED = re.compile(rf"(?<!\w)(?P<title>{'|'.join(t for x in TITLES.values() for t in x)})\.? (?:(?P<given>{CAPITAL}) )?(?P<surname>{CAPITAL})")
#: Neighbouring pairs overlap: any word of a run may be the given name.
PAIR = re.compile(rf"(?<!\w)(?P<given>{CAPITAL})(?= (?P<surname>{CAPITAL}))")
#: One to three initials and a surname, but the two letters of a country; a single one may end a sentence, and needs company.
INITIALS = re.compile(rf"(?<![\w.])(?!U\. ?[SK]\. )(?P<given>(?:[{UPPER}]\. ?){{1,3}})(?<=[. ])(?P<surname>{CAPITAL})(?!\.)")
COMPANY = re.compile(r"(?:[,;(]| (?:and|und|et|y|with|mit|avec|con)) ?$")
WHOLE = re.compile(rf"(?<!\w){CAPITAL}(?![\w])")
POSSESSIVE = re.compile(r"['’]s$", re.IGNORECASE)
#: Java patterns; a text that matches neither and has none of ``@=:`` holds none of the above.
#: Digits are of any script, and those newer than Java's tables, as Python's are.
JAVA_DIGIT = r"[\p{Nd}\p{Cn}]"
MAYBE_NUMBER = rf"{JAVA_DIGIT}{{3}}|{JAVA_DIGIT}\.{JAVA_DIGIT}|{JAVA_DIGIT}(?:[ \u00a0\u202f./()-]{{0,3}}{JAVA_DIGIT}){{6}}|[0-9A-Fa-f]{{32}}|[A-Z]{{2}}{JAVA_DIGIT}{{2}} ?[A-Z0-9]{{4}}"
KEY_STARTS, MAYBE_KEY = ("AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "sk-", "xox", "AIza"), "A[KS]IA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20}|xox[abprs]-|AIza[0-9A-Za-z_-]{35}"
MAYBE_NAME = rf"[{JAVA_UPPER}][^\s.,;:!?]*+ [{JAVA_UPPER}]|[{JAVA_UPPER}]\. ?[{JAVA_UPPER}]|(?:M(?:rs?|s|iss|me|adame|onsieur)|Frau|Herr|S(?:r|ra|eñora?)|Dr|Prof)\. [{JAVA_UPPER}]"


def may_hold(text: Column) -> Column:
    """A cheap test that every text with an entity passes."""
    key = reduce(lambda a, b: a | b, [text.contains(k) for k in KEY_STARTS]) & text.rlike(MAYBE_KEY)
    hit = text.contains("@") | text.contains("=") | text.contains(":") | text.rlike(MAYBE_NUMBER) | text.rlike(MAYBE_NAME) | key
    return F.coalesce(hit, F.lit(False))


def script_name(c: str) -> str:
    """Script of a letter, by the first word of its Unicode name; empty for marks and modifiers."""
    return unicodedata.name(c, "").partition(" ")[0].lower() if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo") else ""


def script_of(word: str) -> str:
    """Script of the word's first letter that has one."""
    return next((s for s in map(script_name, word) if s), "latin")


@cache
def letters_of(script: str) -> str:
    """Letters that names in a script without syllables of its own are made of: the small ones, where it has case."""
    of = [c for c in map(chr, range(0x80, 0x10000)) if script_name(c) == script and unicodedata.normalize("NFC", c) == c]
    small = "".join(c for c in of if c.islower() and len(c.upper()) == 1)
    return small or "".join(of) or ALPHABETS[0]


def luhn(digits: str) -> int:
    """Sum that is a multiple of ten for a right check digit."""
    return sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(reversed(digits)))


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def plain_digits(s: str) -> str:
    """Decimal digits of any script as 0 to 9; the rest stays."""
    return s if s.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in s)


def dialled(s: str) -> str:
    """Country code and the rest of a phone number, the same however it is grouped."""
    s = plain_digits(s)
    digits = re.sub(r"\D", "", s)
    if not s.startswith("+"):
        return f":{digits}"
    code = digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3]
    group = re.match(r"\+\(?(\d+)", s)[1]
    lead = code if group.startswith(code) else group
    return f"{lead}:{digits[len(lead) :]}"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions as (start, end, kind, entity), in order and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    digits = re.search(r"\d", text) is not None
    for kind, need, pattern in PATTERNS:
        if not digits if need == "0" else need and not any(c in text for c in need):
            continue
        for m in pattern.finditer(text):
            start, end = m.span("value") if kind == "assigned" else m.span()
            s, name = text[start:end], "secret" if kind == "assigned" else kind
            if name == "email":
                entity = s.lower()
            elif name == "iban":
                entity = plain_digits(s.replace(" ", ""))
                if iban_rest(entity) != 1:
                    continue
            elif name == "ip":
                entity = plain_digits(s)
                if any(int(x) > 255 for x in s.split(".")):
                    continue
            elif name == "ipv6":
                if len([x for x in s.split(":") if x]) < 3 or not any(c.isdecimal() for c in s):
                    continue
                try:
                    entity = ipaddress.IPv6Address(s).exploded
                except ValueError:
                    continue
            elif name == "secret":
                entity = plain_digits(s.lower())
            else:
                entity = plain_digits(re.sub(r"\D", "", s))
                if name == "phone":
                    entity = dialled(s)
            found.append((start, end, name, entity))
    if digits and NATIONAL.search(text):  # national numbers have a loose shape, and take only what nothing else has taken
        free = list(text)
        for start, end, _, _ in found:
            free[start:end] = "\n" * (end - start)
        found += [(*m.span(), "phone", dialled(m[0])) for m in NATIONAL.finditer("".join(free)) if not NO_PHONE.match(m[0]) and called(text, m)]
    found += names(text)
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def called(text: str, m: re.Match) -> bool:
    """Whether digits are a phone number by their shape; bare ones need a leading 0 and ten or eleven digits, or a word that says so."""
    digits = plain_digits(m[0])
    if not digits.isdigit():
        return True
    return (digits[0] == "0" and digits[1] != "0" and len(digits) in (10, 11)) or CALL.search(text, max(0, m.start() - 40), m.start()) is not None


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions of persons: beside a title, a known given name, initials, a role or a verb, and wherever else in the text a name found so stands."""
    found: list[tuple[int, int, str, str]] = []

    def surname(m: re.Match) -> None:
        start, end = m.span("surname")
        end = start + len(POSSESSIVE.sub("", text[start:end]))
        found.append((start, end, f"surname:{script_of(text[start:end])}", text[start:end].lower()))

    for m in TITLED.finditer(text):
        if m["given"]:
            known = GENDER.get(m["given"].lower())
            gender = known[1] if known else next((g for g, titles in TITLES.items() if m["title"] in titles), "x")
            found.append((*m.span("given"), f"given:{gender}:{script_of(m['given'])}", m["given"].lower()))
        surname(m)
    for m in PAIR.finditer(text):
        known = GENDER.get(m["given"].lower())
        if not known and (m["given"] in ALL_TITLES or m["surname"].lower() in GENDER or not (ROLES.search(text, max(0, m.start() - 24), m.start()) or VERBS.match(text, m.end("surname")))):
            continue
        found.append((*m.span("given"), f"given:{known[1] if known else 'x'}:{script_of(m['given'])}", m["given"].lower()))
        if m["surname"].lower() not in GENDER or not PAIR.match(text, m.start("surname")):
            surname(m)
    for m in INITIALS.finditer(text):
        if m["given"].count(".") > 1 or any(p.search(text, max(0, m.start() - 24), m.start()) for p in (COMPANY, ROLES)) or VERBS.match(text, m.end()):
            surname(m)
    if not found:
        return found
    # A name known in a text is one wherever it stands in it as a word, or a part of a compound, that isn't small.
    entities = {entity: kind for _, _, kind, entity in found if len(entity) > 1}
    for m in WHOLE.finditer(text) if entities else ():
        word = POSSESSIVE.sub("", m[0])
        if word.lower() in entities:
            found.append((m.start(), m.start() + len(word), entities[word.lower()], word.lower()))
        elif len(parts := re.split("['’-]", word)) > 1:
            at = m.start()
            for part in parts:
                if part.lower() in entities and not part[:1].islower():
                    found.append((at, at + len(part), entities[part.lower()], part.lower()))
                at += len(part) + 1
    return found


class Draw:
    """A stream of numbers that a key and a label fix."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.n, self.pool = key, label.encode(), 0, b""

    def below(self, top: int) -> int:
        if len(self.pool) < 8:
            self.pool = hmac.new(self.key, self.n.to_bytes(4, "big") + self.label, hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % top


def same_classes(s: str, draw: Draw) -> str:
    """Digits for digits, letters for letters of the same script; the rest stays."""
    out = []
    for c in s:
        alphabet = next((a for a in ("0123456789", *ALPHABETS) if c.lower() in a), None)
        x = alphabet[draw.below(len(alphabet))] if alphabet else c
        out.append(x.upper() if c.isupper() else x)
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The ``attempt``-th candidate for an entity, in the entity's own canonical form."""
    draw = Draw(key, f"{kind}\0{entity}\0{attempt}")
    if kind == "email":
        local, _, domain = entity.partition("@")
        name, _, top = domain.rpartition(".")
        return f"{same_classes(local, draw)}@{same_classes(name, Draw(key, f'domain{chr(0)}{domain}{chr(0)}{attempt // 4}'))}.{top}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":  # the prefix that is set aside for examples
        return "2001:0db8:" + ":".join(f"{draw.below(1 << 16):04x}" for _ in range(6))
    if kind == "phone":
        lead, _, rest = entity.partition(":")
        return f"{lead}:{same_classes(rest + '0' * (attempt // 8), draw)}"
    if kind == "card":
        body = entity[0] + same_classes(entity[1:-1], draw)
        right = str(-luhn(body + "0") % 10)
        return body + (right if luhn(entity) % 10 == 0 else str((int(right) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = same_classes(entity[4:], draw)
        return f"{entity[:2]}{98 - iban_rest(f'{entity[:2]}00{body}'):02d}{body}"
    if kind == "secret" and re.fullmatch("[0-9a-f]+", entity):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in entity)
    if kind.startswith(("given", "surname")):
        script = kind.rpartition(":")[2]
        if script not in SYLLABLES:  # a name of its length, of letters of its script
            return "".join(letters_of(script)[draw.below(len(letters_of(script)))] for _ in range(max(2, min(len(entity), 12)) + attempt // 8))
        parts = SYLLABLES[script]
        if kind.startswith("surname"):
            return "".join(parts[draw.below(len(parts))] for _ in range(3 + attempt // 8))
        gender = kind.split(":")[1]
        known = [n.lower() for n in GIVEN.get((script, gender)) or [n for (s, _), names in GIVEN.items() if s == script for n in names]]
        if attempt:  # the pool alone is too small: names grow by a syllable with each attempt
            return known[draw.below(len(known))] + "".join(parts[draw.below(len(parts))] for _ in range(attempt))
        if entity in known:  # a shuffle of the pool keeps known names apart; no name stays itself
            order = sorted(known, key=lambda n: Draw(key, f"order{chr(0)}{script}{chr(0)}{n}").below(1 << 62))
            return order[(order.index(entity) + 1) % len(order)]
        return known[draw.below(len(known))]
    start = KEY_START.match(entity) if kind == "secret" else None
    kept = start[0] if start else ""
    return kept + same_classes(entity[len(kept) :], draw)


def family(kind: Column) -> Column:
    """What surrogates must differ within: a kind, or all given names, whose gender a title may leave open."""
    return F.when(kind.startswith("given"), F.lit("given")).otherwise(kind)


def render(mention: str, kind: str, core: str) -> str:
    """``core`` with the separators and the case of the mention it replaces."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(core.replace(":", ""))
        return "".join([chr(ord(c) - int(c) + int(next(digits, c))) if c.isdecimal() else c for c in mention] + list(digits))
    if kind == "iban":
        chars = iter(core)
        return "".join(c if c == " " else next(chars, c) for c in mention)
    if kind == "ipv6":
        short = str(ipaddress.IPv6Address(core))
        return short.upper() if mention.isupper() else short
    if kind.startswith(("given", "surname")):
        return core.upper() if len(mention) > 1 and mention.isupper() else core[:1].title() + core[1:]
    if len(core) == len(mention):
        return "".join(x.upper() if c.isupper() or (mention.isupper() and x.isalpha()) else x for c, x in zip(mention, core))
    return core


def mentions(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct (text_key, kind, entity) of the texts that may hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("pii")
        for batch in batches:
            for part in slices(batch):
                keys, kinds, entities = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for kind, entity in {(k, e) for _, _, k, e in detect(text)}:
                        keys.append(key)
                        kinds.append(kind)
                        entities.append(entity)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(entities, pa.string())], names=["text_key", "kind", "entity"])

    return df.select(F.xxhash64(text_col), text_col).mapInArrow(run, "text_key long, kind string, entity string").distinct()


def draw_all(df: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) with each candidate as ``core``."""

    def run(batches):
        for batch in batches:
            kinds, entities, attempts = (batch.column(n).to_pylist() for n in range(3))
            cores = [surrogate(key, *x) for x in zip(kinds, entities, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cores, pa.string())], names=[*batch.schema.names, "core"])

    return df.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, core string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, core: a surrogate for each distinct entity, without collisions.

    ``core`` is unique within a family of kinds and is no entity of it. Each round
    settles every candidate that no other entity has; the number of rounds grows
    at most with the logarithm of the input, because the spaces drawn from are far
    larger than the entities or grow with each attempt. After MOST_ROUNDS, that is
    where a kind of fixed form has more entities than forms, it raises ValueError.
    """
    pending = entities.select("kind", "entity", F.lit(0).alias("attempt"))
    done: DataFrame | None = None
    of = family(F.col("kind")).alias("family")
    for _ in range(MOST_ROUNDS):
        drawn = stage(draw_all(pending, key).select("*", of), "drawn")
        taken = entities.select(of, F.col("entity").alias("core"))
        if done is not None:
            taken = taken.unionByName(done.select(of, "core"))
        winners = drawn.groupBy("family", "core").agg(F.min(F.struct("entity", "kind")).alias("first")).join(taken, ["family", "core"], "left_anti")
        marked = drawn.join(winners, ["family", "core"], "left").withColumn("won", F.coalesce(F.col("first") == F.struct("entity", "kind"), F.lit(False)))
        marked = stage(marked.select("kind", "entity", "attempt", "core", "won"), "marked")
        unstage(drawn)
        won = marked.filter("won").select("kind", "entity", "core")
        done = won if done is None else done.unionByName(won)
        pending = marked.filter("not won").withColumn("attempt", F.col("attempt") + 1)
        if pending.isEmpty():
            return done
    raise ValueError("a kind of entity has used up its surrogates: " + ", ".join(r["kind"] for r in pending.select("kind").distinct().limit(5).collect()))


def replace_pii(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with surrogates in the text, and ``n_entities``, the mentions replaced.

    A null text stays null and an empty one empty, with no mentions. Rows are
    matched by their text, not their id, so null and repeated ids do no harm, and
    equal texts get equal results; a text of any length is searched as a whole. An
    empty table gives no rows. Columns of other names pass through; one called
    n_entities is replaced.
    """
    df = df.drop("n_entities")
    cols = df.columns
    seen = stage(mentions(df.filter(may_hold(F.col(text_col))), text_col), "mentions")
    entities = stage(seen.select("kind", "entity").distinct(), "entities")
    chosen = few(assign(entities, key), "chosen", F.octet_length("entity") + F.octet_length("core") + 64)
    key_name, map_name = free_name(df, "key"), free_name(df, "map")
    per_text = seen.join(chosen, ["kind", "entity"]).groupBy(F.col("text_key").alias(key_name)).agg(F.collect_list(F.struct("kind", "entity", "core")).alias(map_name))
    joined = df.join(few(per_text, "maps", F.octet_length(F.to_json(map_name))), F.xxhash64(text_col) == F.col(key_name), "left").select(*cols, map_name)
    clean = joined.filter(F.col(map_name).isNull()).drop(map_name).withColumn("n_entities", F.lit(0).cast("long"))
    with_map = joined.filter(F.col(map_name).isNotNull())
    schema = with_map.drop(map_name).withColumn("n_entities", F.lit(0).cast("long")).schema
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("pii")
        for batch in batches:
            for part in slices(batch):
                texts, counts = [], []
                for text, entries in zip(part.column(at).to_pylist(), part.column(len(cols)).to_pylist()):
                    cores = {(e["kind"], e["entity"]): e["core"] for e in entries or ()}
                    out, last, n = [], 0, 0
                    for start, end, kind, entity in detect(text) if cores else ():
                        out += [text[last:start], render(text[start:end], kind, cores[kind, entity])]
                        last, n = end, n + 1
                    texts.append("".join([*out, text[last:]]))
                    counts.append(n)
                columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns[: len(cols)])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*part.schema.names[: len(cols)], "n_entities"])

    return clean.unionByName(with_map.select(*cols, map_name).mapInArrow(run, schema))
