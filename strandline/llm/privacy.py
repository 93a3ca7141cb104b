"""Personal information in free text: spans are proposed by patterns, confirmed by checksums, scored by context.

Each kind has patterns that propose spans with a base score. Checksums (Luhn, the two mod-97 rules) raise the score of
a number that passes; words nearby raise or lower it: a label before an identity number, a unit behind a figure,
a title before a name, a word for places behind it. Spans that reach the threshold are kept, the earlier and longer one where two overlap.
Replacement puts ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]`` in their place and leaves the rest as it is.

Names need a part from the table of name parts beside another capitalised word, initials before a family name, or a title or label
before them. Texts are searched line by line: context is what stands in the same line, and what a worker found in a line
it keeps for the next revision that holds the same line. Cheap signs (a digit, ``@``, a listed part, a title) decide which patterns a line needs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandline.session import bounded_rows, spread

THRESHOLD = 3
#: Characters of lines whose spans a worker keeps; beyond that they are searched anew.
KEPT_CHARACTERS = 1 << 26
#: Lines up to this length are kept.
KEPT_LINE = 4000
KINDS = ("email", "phone", "id_number", "address", "name")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn checksum."""
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return bool(digits) and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number (country, check digits, rest) leaves 1 modulo 97."""
    moved = text[4:] + text[:4]
    return len(text) > 4 and moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def complement97(digits: str) -> bool:
    """Whether the last two of eleven digits complete the first nine to a multiple of 97."""
    return len(digits) == 11 and any(97 - int(lead + digits[:9]) % 97 == int(digits[9:]) for lead in ("", "2"))


# ---- e-mail addresses

_LOCAL = r"[\p{L}\p{N}](?:[\p{L}\p{N}._+'%-]{0,62}[\p{L}\p{N}_+])?"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sDOT\s|\sdot\s)"
_EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}._+%-]){_LOCAL}(?:@|\s?(?:\(at\)|\[at\]|\{{at\}})\s?|\sAT\s|\sat\s(?=[\p{{L}}\p{{N}}-]+(?:\sdot\s)))(?:{_LABEL}{_DOT})+(\p{{L}}{{2,24}})(?![\p{{L}}\p{{N}}])", regex.I)
_EMAIL_HINT = regex.compile(r"@|\(at\)|\[at\]|\{at\}| AT .{1,70}(?:DOT|\(dot\)|\[dot\])| at .{1,70} dot ", regex.I)
#: Endings of files, which stand behind a sign of scale (name@2x.png).
_FILES = frozenset("png jpg jpeg gif svg webp css js py txt pdf html xml zip gz tiff bmp ico mp3 mp4 ogg".split())


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    if not _EMAIL_HINT.search(text):
        return
    for m in _EMAIL.finditer(text):
        plain = "@" in m.group()
        spelled = regex.search(r"\(dot\)|\[dot\]|\{dot\}|\sdot\s|\(at\)|\[at\]|\{at\}", m.group(), regex.I)
        score = 3 if plain or spelled else 0
        if m.group(1).lower() in _FILES:
            score -= 3
        yield m.start(), m.end(), score


# ---- phone numbers

_FIGURES = regex.compile(r"\d(?:\D{0,3}\d){5,}")
_SEP = r"[ .\-/\u00a0]"
_PHONE = regex.compile(
    r"(?<![\p{L}\p{N}+.,:/\-])(?<!\d )(?:"
    rf"(?P<intl>\+[1-9]\d{{0,2}}(?:{_SEP}?\(0\)|{_SEP}?\(\d{{1,4}}\))?(?:{_SEP}?\d{{1,8}}){{1,7}})"
    rf"|(?P<nanp>(?:1[-. ])?(?:\([2-9]\d{{2}}\) ?|[2-9]\d{{2}}[-.])[2-9]\d{{2}}[-. ]\d{{4}})"
    r"|(?P<pairs>0[1-9](?: \d\d){4})"
    r"|(?P<slash>0\d{1,5}/\d{3,8}(?: \d{1,6})?(?: \d{1,4})?)"
    r"|(?P<trunk>\(?0\d{2,5}\)?[ -]\d{3,8}(?:[ -]\d{3,6})?)"
    r")(?![\p{L}\p{N}]|[.,:/\-]\d)(?! \d)"
)
_PHONE_CUE = regex.compile(r"(?:tel|phone|call|mobile|ring|number is|anruf|rens|reserva|booking|fax|fon|llam|appel|cell)\W{0,4}(?:\w+\W{1,3}){0,2}$", regex.I)
_NOT_PHONE = regex.compile(r"(?:isbn|issn|sales|catalogue|inventory|edition|lot|population|coordinates|build|version|checksum|no\.|nr\.|nº|census)\W{0,3}$", regex.I)
_UNIT = regex.compile(r"\s?(?:crowns|marks|francs?|euros?|dollars?|pounds|kg|km|mm?|hectares|visitors|people|inhabitants|copies|units|€|\$|%)(?!\p{L})", regex.I)


def _inside(pattern: regex.Pattern, text: str) -> Iterator[regex.Match]:
    """Matches that begin in a stretch with at least six digits close together, or at most four letters before it."""
    for stretch in _FIGURES.finditer(text):
        at = max(0, stretch.start() - 4)
        while at < stretch.end():
            m = pattern.search(text, at, min(len(text), stretch.end() + 24))
            if not m or m.start() >= stretch.end():
                break
            yield m
            at = max(m.end(), at + 1)


def _phones(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _inside(_PHONE, text):
        digits = sum(c.isdigit() for c in m.group())
        if not 8 <= digits <= 15:
            continue
        kind = m.lastgroup
        score = {"intl": 4, "nanp": 3, "pairs": 3, "slash": 3, "trunk": 3}[kind]
        before = text[max(0, m.start() - 30) : m.start()]
        score += 2 if _PHONE_CUE.search(before) else 0
        score -= 3 if _NOT_PHONE.search(before) or _UNIT.match(text, m.end()) else 0
        yield m.start(), m.end(), score


# ---- identity, insurance, tax and passport numbers

_ID = regex.compile(
    r"(?<![\p{L}\p{N}.,:/\-+])(?:"
    r"(?P<ssn>\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})"
    r"|(?P<nino>[A-CEGHJ-PQ-TW-Z][A-CEGHJ-NPQR-TW-Z](?: ?\d{2}){3} ?[A-D])"
    r"|(?P<passport>[A-Z]{1,2}\d{6,8}|[A-Z]\d{2}[A-Z]{2}\d{4,5})"
    r"|(?P<dotted>\d{2}\.\d{2}\.\d{2}-\d{3}[.\-]?\d{2})"
    r"|(?P<dashed>\d{6}[-+]\d{4,5})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<plain>\d{9,13}|\d{2,3}(?: \d{3}){2,3})"
    r")(?![\p{L}\p{N}]|[.,:/\-]\d)"
)
#: Letters may stand between the digits of an account number, so it is searched in the whole text.
_IBAN = regex.compile(r"(?<![\p{L}\p{N}.,:/\-+])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\p{L}\p{N}]|[.,:/\-]\d)")
_ID_LABEL = regex.compile(
    r"(?:\bssn|\bni number|national insurance|insurance (?:no|number)|passport|pasaporte|passeport|reisepass|personalausweis|ausweis|national id|identity (?:no|number|card)|\bid (?:no|number|card)|\bid\b|\bdni\b|\bnie\b|\bnif\b"
    r"|\btin\b|tax (?:no|number|id)|steuer(?:nummer|-?id|-?nr)|num[ée]ro fiscal|s[ée]curit[ée] sociale|паспорт|инн|снилс)[\s.:#=]*(?:(?:no|nr|nº|n\.º|number|card|№)[\s.:#=]*)?$",
    regex.I,
)
_NOT_ID = regex.compile(r"(?:isbn|issn|catalogue|inventory|shelf|edition|lot|population|coordinates|checksum|rev|build)\W{0,3}(?:no\.?\W{0,2})?$", regex.I)


def _ids(text: str) -> Iterator[tuple[int, int, int]]:
    for m in chain(_inside(_ID, text), _IBAN.finditer(text)):
        kind, found = m.lastgroup, m.group()
        digits = "".join(c for c in found if c.isdigit())
        score = {"ssn": 3 if "-" in found else 1, "nino": 3, "passport": 0, "dotted": 3, "dashed": 1, "iban": 0, "plain": 0}[kind]
        before = text[max(0, m.start() - 34) : m.start()]
        if _ID_LABEL.search(before):
            score += 3
        if kind == "passport" and len(digits) == 7 and found[0] == "X":
            score += 1
        score += 2 * (kind in ("plain", "dotted", "dashed") and complement97(digits)) + (kind == "plain" and luhn(digits)) + 3 * (kind == "iban" and mod97(found.replace(" ", "")))
        score -= 4 if _NOT_ID.search(before) else 0
        yield m.start(), m.end(), score


# ---- street addresses

_NO = r"\d{1,4}(?:[a-hA-H](?![\p{L}\p{N}]))?"
_SIDE = r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room|Floor)\s\d{1,4}[a-zA-Z]?)"
_ENGLISH = r"(?:Street|St\.|St(?![\p{L}.])|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Court|Ct\.?|Close|Terrace|Way|Drive|Dr\.|Place|Square|Sq\.|Crescent|Boulevard|Blvd\.?|Row|Walk|Gardens|Hill|Grove|Parkway|Mews)"
_CAP = r"\p{Lu}[\p{L}'’\-]+"
_LOW = r"(?:d[eu]s?|del|de\sla|de\slas|de\slos|de\sl['’]|d['’]|la|las|los|le|les)"
_ADDRESS = regex.compile(
    r"(?<![\p{L}\p{N}.,:\-])(?:"
    rf"(?P<en>(?:{_SIDE},\s)?{_NO}\s(?:{_CAP}\s){{1,3}}?{_ENGLISH}(?:,\s{_SIDE})?)"
    rf"|(?P<fr>\d{{1,4}}(?:\s?[a-hA-H](?!\p{{L}})|\s(?:bis|ter|quater))?,?\s(?:rue|avenue|boulevard|impasse|chemin|place|quai|all[ée]e|cours|route|square|passage|sentier|faubourg)\s(?:{_LOW}\s?)*{_CAP}(?:[\s-](?:{_LOW}\s?)?{_CAP})*)"
    rf"|(?P<es>(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Carretera|Ronda|Traves[íi]a|Callej[óo]n|Cuesta)\s(?:{_LOW}\s)*{_CAP}(?:\s(?:{_LOW}\s)*{_CAP})*,?\s(?:n\.?\s?º\s?|núm\.\s|n[úu]mero\s)?{_NO}(?:,\s\d+\.?º(?:\s[A-Z])?)?)"
    rf"|(?P<de>(?:\p{{Lu}}[\p{{L}}\-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|stieg|pfad|chaussee|markt|hof|graben)|(?:Am|An\sder|Auf\sder|Auf\sdem|Im|In\sder|Zum|Zur|Unter\sden|Beim|Hinter\sder)\s(?:{_CAP}\s)?{_CAP}|{_CAP}\s(?:Stra(?:ß|ss)e|Weg|Gasse|Platz|Allee|Ring))\s{_NO})"
    r")(?![\p{L}\p{N}])"
)
_NOT_ADDRESS = regex.compile(r"(?:^|[\s(])(?:route|line|no\.|the|class)\s$", regex.I)
_NOT_BEHIND = regex.compile(r"\s(?:class|station|yard|line)(?!\p{L})", regex.I)
_GERMAN_PLACE = regex.compile(r"(?:(?:Am|Im|Zum|Zur)\s)")
_DATE = regex.compile(r"\s(?:January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|km|Uhr|Einwohner|[.,]\d|v\.)|\.\s(?:Sonntag|Jahrhundert|März|Mai)", regex.I)


#: One of these words, or a word with one of these endings, stands in every address.
_STREET_WORDS = frozenset(
    "street st road rd avenue ave lane ln court ct close terrace way drive dr place square sq crescent boulevard blvd row walk gardens hill grove parkway mews "
    "rue impasse chemin quai allée allee cours route passage sentier faubourg calle c avenida avda av plaza pza paseo p camino carretera ronda travesía travesia callejón callejon cuesta am an auf im in zum zur unter beim hinter".split()
)
_STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig", "stieg", "pfad", "chaussee", "markt", "hof", "graben")
_WORD = re.compile(r"[^\W\d_]+")


def _addresses(text: str, words: frozenset[str] | set[str] | None = None) -> Iterator[tuple[int, int, int]]:
    words = set(_WORD.findall(text.lower())) if words is None else words
    if _STREET_WORDS.isdisjoint(words) and not any(w.endswith(_STREET_ENDS) for w in words):
        return
    for m in _ADDRESS.finditer(text):
        before, kind = text[max(0, m.start() - 14) : m.start()], m.lastgroup
        score = 3
        if _NOT_ADDRESS.search(before) or _NOT_BEHIND.match(text, m.end()):
            score -= 3
        if kind == "de" and (_DATE.match(text, m.end()) or (_GERMAN_PLACE.match(m.group()) and len(regex.search(r"\d+", m.group()).group()) > 3)):
            score -= 3
        yield m.start(), m.end(), score


# ---- names

_W = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+(?:['’\-]\p{L}[\p{L}\p{M}]*)*"
_I = r"\p{Lu}\."
_P = r"(?:van\sder|van\sden|van|von\sder|von|de\sla|de|del|der|di|da|af|ten|ter|zu|la|le)"
_HEAD = r"(?<![\p{L}\p{N}@._+'’\-/])"
_TAIL = r"(?![\p{L}\p{N}]|[@_+]|-\p{L})"
_FULL = rf"(?:{_W}\s(?:(?:{_W}|{_I})\s)?(?:{_P}\s)?{_W}|{_W},\s{_W}(?:\s{_I}|\s{_W})?|(?:{_I}\s?){{1,3}}(?:{_P}\s)?{_W})".replace(r"\s", "[ \u00a0]")
_FORWARD = regex.compile(rf"{_W}\s(?:({_W}|{_I})\s)??(?:{_P}\s)?({_W}){_TAIL}".replace(r"\s", "[ \u00a0]"))
_FORWARD_LONG = regex.compile(rf"{_W}\s(?:{_W}|{_I})\s(?:{_P}\s)?({_W}){_TAIL}".replace(r"\s", "[ \u00a0]"))
_INITIALS_BACK = regex.compile(rf"{_HEAD}(?:{_I}\s?){{1,3}}(?:{_P}\s)?$".replace(r"\s", "[ \u00a0]"))
_WORDS_BACK = regex.compile(rf"{_HEAD}({_W})\s(?:(?:{_W}|{_I})\s)?(?:{_P}\s)?$".replace(r"\s", "[ \u00a0]"))
_WORD_BACK = regex.compile(rf"{_HEAD}({_W})\s(?:{_I}\s)?(?:{_P}\s)?$".replace(r"\s", "[ \u00a0]"))
_COMMA_BACK = regex.compile(rf"{_HEAD}(?:{_P}\s)?({_W}),\s$".replace(r"\s", "[ \u00a0]"))
_COMMA_NEXT = regex.compile(rf",\s({_W})(?:\s{_I})?{_TAIL}(?!\s{_W})".replace(r"\s", "[ \u00a0]"))
_TITLE = r"(?:Herrn?|Frau|Fr\.|Mme|Mlle|Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Sir|Señora?|Sra?\.|Don|Doña|Monsieur|Madame|M\.)"
_TITLES = frozenset("herr herrn frau mme mlle mr mrs ms miss dr prof sir señor señora don doña monsieur madame".split())
#: Words for places, buildings and companies, which make one of the name before or behind them.
_PLACE = frozenset(
    "hall heights island bridge cross falls point bay springs creek chapel guild road street lane park press trust district station university college school hotel museum library castle tower river lake mountain valley hill hills church abbey "
    "cathedral beach harbour harbor square avenue court gardens forest woods county city town village company ltd inc gmbh bank group foundation society institute airport theatre theater stadium arena building house centre center "
    "port saint st saint-st san santa storm hurricane mount fort cape class terrace close way islands canyon gate farm mill".split()
)
_BEFORE_PLACE = frozenset("port saint st storm hurricane mount fort cape san santa lake river".split())
#: Words that begin sentences and labels; capitalised, they are no part of a name.
_NO_NAME = frozenset(
    "a an and at by for from in of on or the this that to with my your his her our their it is was signed contact name author editor owner thanks according see call ask dear "
    "der die das ein eine und im in am von vom zum zur mit für le la les un une et du des de en par pour el los las un una y del con por para flat unit suite apt".split()
)
#: Titles, and labels of fields and lines that hold a person's name.
_CUE = rf"(?:(?<!\p{{L}}){_TITLE}[ \u00a0]|(?<!\p{{L}})(?i:name|contact|author|editor|owner|signed)[ ]?[:=,][ ]?)"
_CUE_BEFORE = regex.compile(rf"{_CUE}$")
_CUE_FULL = regex.compile(rf"{_CUE}(?:{_TITLE}[ \u00a0])?({_FULL}){_TAIL}")
#: Initials and a family name, or a given name, initials and a family name, whether or not a part is listed.
_WITH_INITIALS = regex.compile(rf"{_HEAD}(?:{_W}\s)?(?:{_I}\s?){{1,3}}(?:{_P}\s)?(\p{{Lu}}[\p{{L}}'’\-]{{2,}}){_TAIL}".replace(r"\s", "[ \u00a0]"))
_INITIAL_SIGN = re.compile(r"(?<!\w)[^\W\d_]\.")
_CUE_WORDS = _TITLES | frozenset("fr sr sra m señor señora name contact author editor owner signed".split())
#: A full name right before another finding of the line, in a field of its own.
_NAME_BESIDE = regex.compile(rf"(?:^|[|:;>(/][ ]?|\s{2})({_FULL})[ ]?(?:<|\|\||[/,;:(–-])[ ]?$")
_DIGIT = re.compile(r"\d")


def _is_plain(name: str) -> bool:
    """Whether no word of a proposed name is a title or a word for places or one that begins sentences."""
    return (_PLACE | _TITLES | _NO_NAME).isdisjoint(w.strip(".") for w in regex.split(r"[ ,\u00a0]+", name.lower()))


class Names:
    """Finds names with a table of name parts: lists of given and of family names."""

    def __init__(self, given: list[str], family: list[str]) -> None:
        self.given, self.family = {g.lower() for g in given}, {f.lower() for f in family}
        both = sorted({p for x in [*given, *family] for p in (x, x.upper())}, key=len, reverse=True)
        self.parts = regex.compile(rf"{_HEAD}\L<parts>{_TAIL}", parts=both) if both else None
        self.pieces = {w for p in both for w in _WORD.findall(p.lower())}

    def spans(self, text: str, words: set[str], beside: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int]]:
        """Spans with their scores; ``words`` are the line's words in lower case, ``beside`` what was found in it before."""
        end = 0
        if self.parts and not self.pieces.isdisjoint(words):
            for m in self.parts.finditer(text):
                if m.start() < end:
                    continue
                found = self._from_given(text, m) if m.group().lower() in self.given else self._from_family(text, m)
                if found and found[1] > end:
                    end = found[1]
                    yield found
        if _INITIAL_SIGN.search(text):
            for m in _WITH_INITIALS.finditer(text):
                start = m.start()
                first = regex.match(r"[\p{L}'’\-]+(?=[ \u00a0])", m.group())
                if first and first.group().lower() in _TITLES | _NO_NAME | _PLACE:
                    start += first.end() + 1
                yield start, m.end(), self._score(text, start, m.end(), 0) + (3 if m.group(1).lower() not in _PLACE | _NO_NAME else 0)
        if not _CUE_WORDS.isdisjoint(words):
            for m in _CUE_FULL.finditer(text):
                if _is_plain(m.group(1)):
                    yield m.start(1), m.end(1), 3
        for start, _, kind in beside:
            m = _NAME_BESIDE.search(text, max(0, start - 70), start) if kind != "address" else None
            if m and _is_plain(m.group(1)):
                yield m.start(1), m.end(1), 3

    def _score(self, text: str, start: int, end: int, known: int) -> int:
        """Points for listed parts and a title or label before; a word for places on either side takes them away."""
        score = 2 * known + (2 if _CUE_BEFORE.search(text, max(0, start - 40), start) else 0)
        before = regex.search(r"(\p{L}+)\s+'*$", text[max(0, start - 16) : start])
        if before and before.group(1).lower() in _BEFORE_PLACE:
            score -= 6
        behind = regex.match(r"\s(\p{L}+)", text[end : end + 20])
        if behind and behind.group(1).lower() in _PLACE - {"way", "close", "class"} and behind.group(1)[0].isupper():
            score -= 6
        return score

    def _from_given(self, text: str, m: regex.Match) -> tuple[int, int, int] | None:
        back = _COMMA_BACK.search(text, max(0, m.start() - 40), m.start())
        if back and back.group(1).lower() not in _TITLES and not regex.match(rf"[ \u00a0](?:{_I}[ \u00a0])?(?:{_P}[ \u00a0])?{_W}", text[m.end() : m.end() + 60]):
            known = back.group(1).lower() in self.family
            middle = regex.match(rf"[ \u00a0]{_I}(?!\p{{L}})", text[m.end() : m.end() + 4])
            end = m.end() + (middle.end() if middle else 0)
            # an unlisted family name stands alone with its given name, not in a sentence or a row of given names
            alone = back.group(1).lower() not in self.given | _PLACE | _NO_NAME and not regex.match(r"[ \u00a0]\p{L}", text[end : end + 2])
            return back.start(), end, self._score(text, back.start(), end, 1 + known) + (1 if alone else 0)
        short, long = _FORWARD.match(text, m.start()), _FORWARD_LONG.match(text, m.start())
        best = None
        if long and (long.group(1).lower() in self.family or (short and short.group(2).lower() in self.given) or not short):
            best = (long.end(), long.group(1))
        if short and not (best and short.group(2).lower() not in self.family):
            best = (short.end(), short.group(2))
        if not best or best[1].lower() in _PLACE:
            return None
        last = best[1].lower()
        start = m.start()
        lead = _WORD_BACK.search(text, max(0, start - 40), start)
        if lead and last in self.family and lead.group(1).lower() not in _TITLES | _PLACE and lead.group(1).lower() not in _NO_NAME and (lead.start() == 0 or text[lead.start() - 1] in "=|"):
            start = lead.start()
        shaped = 1 if best[1][1:] == best[1][1:].lower() or "-" in best[1] or "'" in best[1] or m.group().isupper() else 0
        return start, best[0], self._score(text, start, best[0], 1 + (last in self.family)) + shaped

    def _from_family(self, text: str, m: regex.Match) -> tuple[int, int, int] | None:
        low = max(0, m.start() - 48)
        back = _INITIALS_BACK.search(text, low, m.start())
        if back:
            words = _WORD_BACK.search(text, low, m.start())
            start = words.start() if words and words.group(1).lower() not in _TITLES | _PLACE | _NO_NAME else back.start()
            return start, m.end(), 3
        following = _COMMA_NEXT.match(text, m.end())
        if following and following.group(1).lower() in self.given:
            return m.start(), following.end(), self._score(text, m.start(), following.end(), 2)
        for pattern in (_WORDS_BACK, _WORD_BACK):
            back = pattern.search(text, low, m.start())
            if back and back.group(1).lower() not in _TITLES | _PLACE | _NO_NAME:
                return back.start(), m.end(), self._score(text, back.start(), m.end(), 1) + 1
        if following and following.group(1).lower() not in _PLACE | _NO_NAME:
            alone = not regex.match(r"[ \u00a0]\p{L}", text[following.end() : following.end() + 2])
            return m.start(), following.end(), self._score(text, m.start(), following.end(), 1) + (1 if alone else 0)
        return None


class Finder:
    """All kinds together."""

    def __init__(self, given: list[str], family: list[str]) -> None:
        self.names = Names(given, family)
        self.kept: dict[str, tuple[tuple[int, int, str], ...]] = {}
        self.kept_characters = 0

    def find(self, text: str | None) -> list[Span]:
        """The spans of a text in order, without overlaps; none for null and empty texts."""
        if not text:
            return []
        out, at, kept = [], 0, self.kept
        for line in text.split("\n"):
            found = kept.get(line)
            if found is None:
                found = self._find_in_line(line)
                if len(line) <= KEPT_LINE:
                    if self.kept_characters >= KEPT_CHARACTERS:
                        kept.clear()
                        self.kept_characters = 0
                    kept[line] = found
                    self.kept_characters += len(line)
            if found:
                out += [Span(at + s, at + e, kind) for s, e, kind in found]
            at += len(line) + 1
        return out

    def _find_in_line(self, text: str) -> tuple[tuple[int, int, str], ...]:
        digits, words = _DIGIT.search(text) is not None, set(_WORD.findall(text.lower()))
        found: list[tuple[int, int, str]] = []
        for kind in ("email", "id_number", "phone", "address", "name"):
            if kind == "email":
                source = _emails(text)
            elif kind == "name":
                source = self.names.spans(text, words, found)
            elif digits:
                source = _ids(text) if kind == "id_number" else _phones(text) if kind == "phone" else _addresses(text, words)
            else:
                continue
            proposed = sorted((x for x in source if x[2] >= THRESHOLD), key=lambda x: (x[0], -x[1]))
            if not proposed:
                continue
            kept: list[tuple[int, int]] = []
            taken = sorted((s, e) for s, e, _ in found)
            starts = [s for s, _ in taken]
            for start, end, _ in proposed:
                before = bisect_right(starts, start)
                free = (before == 0 or taken[before - 1][1] <= start) and (before == len(taken) or taken[before][0] >= end)
                if free and (not kept or kept[-1][1] <= start):
                    kept.append((start, end))
            found += [(s, e, kind) for s, e in kept]
        return tuple(sorted(found))

    def redact(self, text: str | None) -> str | None:
        """The text with typed placeholders; null stays null."""
        if text is None:
            return None
        out, at = [], 0
        for span in self.find(text):
            out += [text[at : span.start], f"[{span.kind.upper()}]"]
            at = span.end
        return "".join(out) + text[at:]


_finders: dict[tuple, Finder] = {}


def _shared_finder(parts: list[list[str]]) -> Finder:
    key = (tuple(parts[0]), tuple(parts[1]))
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(*parts)
    return _finders[key]


def _parts(name_parts: DataFrame) -> list[list[str]]:
    rows = name_parts.where("name_part is not null and part_kind in ('given', 'family')").select("name_part", "part_kind").distinct()
    rows = bounded_rows(rows, "the table of name parts")
    return [sorted(r["name_part"] for r in rows if r["part_kind"] == k) for k in ("given", "family")]


def find(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, pii_kind, pii_text, start``: every span of personal information, in code points from 0.

    Null and empty texts give no rows. The table of name parts is a parameter and is sent to the tasks.
    """
    parts = _parts(name_parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _shared_finder(parts)
        for batch in batches:
            rows = [(k, s.kind, t[s.start : s.end], s.start) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in finder.find(t)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.string(), pa.string(), pa.int32()))], names=[key, "pii_kind", "pii_text", "start"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, "text")).mapInArrow(run, f"`{key}` {kind}, pii_kind string, pii_text string, start int")


def redact(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, text``: every text with typed placeholders, the rest unchanged. Null stays null, empty stays empty."""
    parts = _parts(name_parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _shared_finder(parts)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([finder.redact(t) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, "text")).mapInArrow(run, f"`{key}` {kind}, text string")
