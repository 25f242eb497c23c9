"""Personal information in free text: found, typed and replaced by placeholders.

Disguises are undone by transducers that keep, for every sign of their output, the place in the source it came from:
compatibility forms, invisible signs and look-alike letters of another script in all of the text; then, for the grammars
they matter to, spelled digits, at/dot words in brackets, words broken over a line end, and digits read for letters
inside words. All five kinds are found in the normalised text and their spans mapped back, so that values come out exactly
as they stand in the field.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secrets import Spans

KINDS = ["email", "phone", "identity_number", "street_address", "name"]
LEXICON_ROWS = 200_000  # the most rows of the name lexicon that are sent to the executors

# ---------------------------------------------------------------------------------------------- transducers


class Mapped:
    """A text and, per sign, the start of its origin in the source; ends[k] is where sign k's origin ends."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, source: str) -> Mapped:
        return cls(source, range(len(source)), range(1, len(source) + 1))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]

    def rewrite(self, pattern: re.Pattern, by) -> Mapped:
        """Every match replaced; all signs of a replacement come from the whole match, unless the length stays."""
        if not pattern.search(self.text):
            return self
        out, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = by(m) if callable(by) else by
            out += [self.text[at:a], new]
            starts += [*self.starts[at:a], *(self.starts[a:b] if len(new) == b - a else [self.starts[a]] * len(new))]
            ends += [*self.ends[at:a], *(self.ends[a:b] if len(new) == b - a else [self.ends[b - 1]] * len(new))]
            at = b
        return Mapped("".join(out) + self.text[at:], [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])


#: Look-alike letters of other scripts (fixed values).
LOOKALIKE = str.maketrans("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaopvABEZHIKMNOPTYX")
#: Spelled digits in the five languages (fixed values).
DIGITS = {w: str(d) for d, ws in enumerate(["zero oh null cero zéro ноль", "one eins uno un один", "two zwei dos deux два", "three drei tres trois три", "four vier cuatro quatre четыре", "five fünf cinco cinq пять", "six sechs seis шесть", "seven sieben siete sept семь", "eight acht ocho huit восемь", "nine neun nueve neuf девять"]) for w in ws.split()}
PLUS = ["plus", "más", "плюс"]
SPELLED = re.compile(r"(?i)\b(?:%s|%s)(?:[ \-,.]+(?:%s)){5,}\b" % ("|".join(PLUS), *("|".join(map(re.escape, DIGITS)),) * 2))
COMPAT = re.compile("[\xaa\xb2\xb3\xb9\xba！-～⁰-₟℀-⅏\U0001d400-\U0001d7ffﬀ-ﬆ]")
AT = re.compile(r"(?i)[ \t]*(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\]|\(arroba\)|\[arroba\]|\(собака\)|\[собака\])[ \t]*")
DOT = re.compile(r"(?i)[ \t]*(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(\.\)|\[\.\]|\(punkt\)|\[punkt\]|\(point\)|\[point\]|\(punto\)|\[punto\]|\(точка\)|\[точка\])[ \t]*")
PLAIN_AT = re.compile(r"(?i)(?<=[\w]) (?:at|arroba|chez|собака) (?=[\w\-]+(?: (?:dot|punkt|point|punto|точка) \w+)+)")
PLAIN_DOT = re.compile(r"(?i)(?<=[\w]) (?:dot|punkt|point|punto|точка) (?=\w)")
#: A word of Latin letters and look-alikes of another script.
MIXED = re.compile(r"[^\W\d_]*(?:[A-Za-z][Ͱ-ϿЀ-ӿԀ-ԯ]|[Ͱ-ϿЀ-ӿԀ-ԯ][A-Za-z])[^\W\d_]*")
#: The same in a mailbox, over its dots and signs.
MIXED_MAILBOX = re.compile(r"[A-Za-z0-9._+\-]*[Ͱ-ϿЀ-ӿ]+[A-Za-z0-9._+\-Ͱ-ϿЀ-ӿ]*@|(?<=@)[\w.\-]*[Ͱ-ϿЀ-ӿ][\w.\-]*")
INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def _latin(m: re.Match) -> str:
    """A mixed word in Latin letters, if all of its letters have a look-alike there; else as it is."""
    word = m.group().translate(LOOKALIKE)
    return word if not re.search("[Ͱ-ϿЀ-ӿԀ-ԯ]", word) else m.group()


def normalised(text: str) -> Mapped:
    """Compatibility forms, invisible signs and mixed scripts undone."""
    m = Mapped.of(text)
    if text.isascii():
        return m
    m = m.rewrite(COMPAT, lambda x: unicodedata.normalize("NFKC", x.group()))
    # a soft hyphen at a line end stands for a break, which labels look at
    return m.rewrite(re.compile(INVISIBLE.pattern + r"(?!\n)"), "").rewrite(MIXED, _latin)


def undisguised(m: Mapped) -> Mapped:
    """Mailboxes written with words for their signs, and with look-alike letters."""
    low = m.text
    if "at" in low or "AT" in low or "@" in low or "arroba" in low or "собака" in low:
        m = m.rewrite(AT, "@").rewrite(DOT, ".")
        if PLAIN_AT.search(m.text):
            m = m.rewrite(PLAIN_AT, "@").rewrite(PLAIN_DOT, ".")
        if "@" in m.text:
            m = m.rewrite(MIXED_MAILBOX, lambda x: x.group().translate(LOOKALIKE) if re.search(r"[A-Za-z]", x.group()) else x.group())
    return m


def _digits(m: re.Match) -> str:
    """Spelled digits as a run; signs other than blanks and hyphens between all of them keep groups apart."""
    words = re.split(r"([ \-,.]+)", m.group())
    out = ["+"] if words[0].lower() in PLUS else [DIGITS[words[0].lower()]]
    for between, word in zip(words[1::2], words[2::2]):
        out += ["-" if re.search(r"[,.]", between) else "", DIGITS[word.lower()]]
    return "".join(out)


def spelled_out(m: Mapped) -> Mapped:
    """Spelled digits as digits."""
    low = m.text.lower()
    return m.rewrite(SPELLED, _digits) if sum(map(low.count, DIGITS)) >= 6 else m


#: Signs that scanning confuses with letters inside words (fixed values).
SCANNED = str.maketrans({"0": "o", "1": "l", "!": "i", "5": "s", "6": "b", "8": "b", "9": "g", "|": "l"})
SCAN_WORD = re.compile(r"(?<![\w!|])(?=[\w!|]*[^\W\d_]{2})[\w!|]*[01!5689|][\w!|]*(?![\w!|])")


def readable(m: Mapped) -> Mapped:
    """For labels only: lower case, words joined over line ends, blanks as one, digits inside words read as letters."""
    m = m.rewrite(re.compile(r"(?<=[^\W\d_])[\-\xad¬‐]\n(?=[^\W\d_])"), "").rewrite(re.compile(r"[^\S ]\s*| \s+"), " ")
    m = m.rewrite(SCAN_WORD, lambda x: x.group().translate(SCANNED))
    low = m.text.lower()
    return Mapped(low if len(low) == len(m.text) else "".join(c.lower()[:1] for c in m.text), m.starts, m.ends)


# ---------------------------------------------------------------------------------------------- grammars

EMAIL = re.compile(r"(?<![\w.+\-@/:])[^\W_][\w.+\-']*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![\w@\-])|(?<=mailto:)[\w][\w.+\-']*@[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![\w@\-])|(?<=[a-z]:)(?<!//)[A-Za-z0-9][\w.+\-]*@[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![\w@\-])")
URL = re.compile(r"(?i)(?<![\w+.\-])[a-z][\w+.\-]*://\S*")
REPOSITORY = re.compile(r":[\w\-./]+\.git")
DIGIT = re.compile(r"\d")
FOUR_DIGITS = re.compile(r"\d\D*\d\D*\d\D*\d")
#: Letters of another script beside digits, as numbers of documents have them.
LETTERED = re.compile(r"(?<!\w)[^\W\d_]{1,3}(?=[ ]?\d)|(?<=\d)[^\W\d_]{1,3}(?!\w)")
NO_MAILBOX = re.compile(r"^(?:git|svn|hg|ssh)@", re.I)

PHONE = re.compile(
    r"""(?x)(?<![\w@.+/\-])(?<!\d[ ])(?:
      \+1[ .\-]?\(?[2-9]\d{2}\)?[ .\-]?\d{3}[ .\-]?\d{4} | \+?1[ .\-]\(?[2-9]\d{2}\)?[ .\-]\d{3}[ .\-]\d{4}
    | \([2-9]\d{2}\)[ ]?\d{3}[ .\-]\d{4} | [2-9]\d{2}([ .\-])\d{3}\1\d{4}
    | (?:\+7|\b8)[ \-]?\(?\d{3}\)?[ \-]?\d{3}[ \-]\d{2}[ \-]?\d{2} | \+7\d{10}
    | (?:\+44[ ]?(?:\(0\))?|0)7\d{3}[ ]?\d{6} | \+44[ ]?\(?\d{2,4}\)?[ ]?\d{3,4}[ ]?\d{3,4} | 0(?:20[ ]\d{4}[ ]\d{4}|1\d{3}[ ]\d{6})
    | (?:\+33|0033)[ .]?(?:\(0\))?[1-9](?:[ .\-]?\d{2}){4} | 0[1-9](?:([ .\-])\d{2})(?:\2\d{2}){3}
    | (?:\+34|0034)[ ]?[6-9]\d{2}(?:[ .\-]?\d{3}){2} | (?:\+34|0034)[ ]?[6-9]\d{2}(?:[ .\-]?\d{2}){3} | [69]\d{2}[ ]\d{3}[ ]\d{3}(?!\d)
    | (?:\+49|0049)[ ]?\(?0?\)?[ ]?\d{2,4}[ \-/]?\d{3,8}(?:[ \-]\d{2,5})? | \(0\d{2,4}\)[ ]?\d{3,8}(?:[ \-]\d{2,5})? | 0\d{2,4}[ /\-]\d{4,8}(?:[ \-]\d{2,5})?
    )(?:[ ]?(?:ext\.?|x|доб\.?|poste|Durchwahl|ext[eé]nsi[oó]n)[ ]?\d{1,5})?(?![\d@]|[.\-/]\d|-[A-Za-z])"""
)
NO_PHONE = re.compile(r"(?i)(?:card|part|ticket|invoice|order|order_no|epoch|serial|checksum|iban|pan|version|build|host|tile|isbn|sku)[\s:=#№]*$")

#: Shapes of the numbers authorities give (fixed values).
ID_SHAPE = r"""(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b|[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|[12]\d{12,14}|\d{3}-\d{3}-\d{3}[ \-]\d{2}|\d{3}-\d{7}-\d|\d{2} \d{2} \d{6}|\d{4} \d{6}|\d{2} \d{3} \d{3} \d{3}|\d{2}[A-Z]{2}\d{5}|[A-Z]{1,3}\d{5,9}[A-Z]?|[A-Z]\d{3}[A-Z]{3}\d{1,5}|[A-Z]\d{2}[A-Z0-9]{6,8}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[CFGHJKLMNPRTVWXYZ][0-9A-Z]{6,9}|\d{4}[ ]?\d{4}[ ]?\d{4}[ ]?\d{4}|\d{9,12}|\d{16}|[A-Z]{2}[0-9A-Z]{6,12})"""
ID_VALUE = re.compile(ID_SHAPE + r"(?![\w\-])")
#: What the numbers are called, per language (fixed values); a blank may be missing, (...) are optional parts.
LABELS = """
ssn; social security (no.|number|nr.|#); national insurance (no.|number); nino; passport (no.|number|nr.); passports; driver licence (no.|number); driver license (no.|number)
driver's licence (no.|number); driver's license (no.|number); driving licence (no.|number); driving license (no.|number); id card (no.|number); identity card (no.|number); tax id
health policy (no.|number); health insurance (no.|number); insurance number; policy number; numéro de sécurité sociale; passeport; permis de conduire; carte d'identité; carte nationale d'identité; carte vitale
reisepass; personalausweis; führerschein; steuer-id; steueridentifikationsnummer; sozialversicherungsnummer; krankenversicherungsnummer
dni; nie; nif; pasaporte; permiso de conducir; número de la seguridad social; tarjeta sanitaria
паспорт (рф); паспорт серия и номер; паспорта; снилс; инн; полис (омс); водительское удостоверение; загранпаспорт
"""
#: What scanning makes of letters (fixed values).
MISREAD = {"e": "[ec]", "c": "[ce]", "i": "[il1!]", "l": "[li1!]", "o": "[o0]", "s": "[s5]", "t": "[tf]", "m": "(?:m|rn|nn)", "n": "(?:n|ri)", "u": "(?:u|ii)", "d": "(?:d|cl)", "h": "(?:h|li)", "b": "[b6]", "g": "[g9]", "é": "[éec]", "и": "[ин]", "н": "[ни]", "т": "[тm]", "л": "(?:л|jl)", "ы": "(?:ы|ьl|ьi)", "п": "(?:п|гі|ri|n)", "д": "[дq]", "о": "[о0o]", "в": "[в8b]", "с": "[сc]", "р": "[рp]", "м": "[мm]", "ь": "[ьb]"}


def _label(words: str) -> str:
    """A pattern of one label; in words of six letters and more every letter may be misread."""
    out = []
    for w in re.findall(r"\([^)]*\)|\S+", words):
        if w[0] == "(":
            out.append("(?:[ ]?(?:" + "|".join(map(re.escape, w[1:-1].split("|"))) + "))?")
        else:
            out.append(("[ ]?" if out else "") + "".join(MISREAD.get(c, re.escape(c)) if len(w) >= 6 or c == "й" else "['’]" if c == "'" else re.escape(c) for c in w))
    return "".join(out)


_LABEL_LIST = sorted((x.strip() for line in LABELS.strip().splitlines() for x in line.split(";")), key=lambda x: len(re.sub(r" ?\(.*?\)", "", x)), reverse=True)
LABEL = re.compile(r"(?<!\w)(?:" + "|".join(map(_label, _LABEL_LIST)) + r")(?:[ ]?[:=№#]|[ ]?n[°º]|[ ]nr\.?|[ ]no\.?|[ ]nu[mn]ber)*[ ]?(?=[\"'«(]?[^\W_])")
STRUCTURED = [re.compile(rf"<(?:no|id|number|doc)>(?P<v>{ID_SHAPE})</"), re.compile(rf""""(?:id|no|document|doc_no|ssn|passport|number)"\s*:\s*"(?P<v>{ID_SHAPE})\""""), re.compile(rf"(?<=;)(?P<v>{ID_SHAPE})(?=;)"), re.compile(rf"(?<=',')(?P<v>\d{{3}}-\d{{2}}-\d{{4}})(?=')")]

CAP = r"[A-ZÀ-ÖØ-Þ][\wà-öø-ÿ'’]+"
HOUSE = r"\d{1,4}(?:[ ]?[a-z](?![a-z]))?"
ADDRESS = re.compile(
    rf"""(?x)
      (?<![\w\-/.])\d{{1,5}}(?:[ ]?[a-zA-Z](?=[ ]))?(?:[ ](?:bis|ter))?,?[ ](?:(?:Old|North|South|East|West|New|Upper|Lower|Great|St\.?|{CAP})[ ]){{0,2}}{CAP}[ ](?:Street|Avenue|Lane|Road|Drive|Court|Boulevard|Way|Place|Square|Terrace|Close|Crescent|(?:Rd|Ct|St|Ave|Ln|Dr|Blvd|Pl|Sq)\b\.?)(?![\w])
    | (?<![\w\-/.])\d{{1,5}}[ ]?[a-zA-Z]?(?:[ ](?:bis|ter|quater))?,?[ ](?:rue|avenue|impasse|boulevard|place|chemin|all[ée]e|quai|cours|route|square)(?:[ ](?:de[ ]la|de[ ]l['’]|de|du|des|d['’]))?[ ]?(?:{CAP})(?:[\- ]{CAP})?
    | (?<!\w)(?:calle|C/|avenida|avda\.|plaza|paseo|camino|ronda|Calle|Avenida|Plaza|Paseo)(?:[ ](?:de[ ]la|de[ ]los|del|de))?[ ]{CAP}(?:[ ]{CAP})?,?[ ](?:n[.º°]+[ ]?)?{HOUSE}
    | (?<!\w)(?:(?:Am|An[ ]der|Im|Zum|Zur|Auf[ ]dem|Unter[ ]den|In[ ]der)[ ]{CAP}|[A-ZÄÖÜ][\wäöüß]+(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)|[A-ZÄÖÜ][\wäöüß]+er[ ](?:Straße|Weg|Platz|Allee|Str\.))[ ]{HOUSE}
    | (?<!\w)(?:ул\.|улица|пер\.|переулок|пр-т|проспект|пр\.|б-р|бульвар|наб\.|набережная|ш\.|шоссе|пл\.|площадь|проезд)[ ][А-ЯЁ][а-яё\-]+(?:[ ][А-ЯЁа-яё\-]+)?,[ ](?:д\.?[ ]?|дом[ ])?\d{{1,4}}[ ]?[a-zа-я]?(?![\wа-я])(?:,?[ ](?:кв|корп|стр)\.[ ]?\d+)?
    | (?<!\w)[А-ЯЁ][а-яё\-]+(?:ский|ская|ый|ая|ий|ой)[ ](?:ул\.|улица|пер\.|переулок|пр-т|проспект|б-р|бульвар|проезд|наб\.|ш\.|пл\.),?[ ](?:д\.?[ ]?|дом[ ])?\d{{1,4}}[ ]?[a-zа-я]?(?![\wа-я])"""
)

LATIN = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['’][A-ZÀ-Þ]?[a-zß-ÿ]+)?|[A-ZÀ-ÖØ-Þ]{3,})(?:-(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]{3,}))?"
RUS = r"(?:[А-ЯЁ][а-яё]+|[А-ЯЁ]{3,})(?:-(?:[А-ЯЁ][а-яё]+|[А-ЯЁ]{3,}))?"


def _name_pattern(word: str, capital: str) -> re.Pattern:
    initial = rf"[{capital}]\."
    return re.compile(
        rf"(?<![\w@.\-/])(?:(?P<a>{word}), (?P<b>{word})(?: {initial})?|(?P<i>{initial}(?: ?{initial})?) ?(?P<c>{word})|(?P<d>{word}) (?P<j>{initial}(?: ?{initial})?)(?: (?P<e>{word}))?|(?P<f>{word}) (?P<g>{word}))(?![\w@])(?!-\w)"
    )


NAME_LATIN = _name_pattern(LATIN, "A-ZÀ-ÖØ-Þ")
NAME_RUS = _name_pattern(RUS, "А-ЯЁ")
PAIR = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w.'’\-]*,? [A-ZÀ-ÖØ-ÞА-ЯЁ]")
#: Words that stand before a name and are no part of it (fixed values).
TITLES = frozenset("dear holder contact please call holder signed mr mrs ms dr herr frau madame monsieur señor señora sr sra don doña joindre llamar joignez appelez antragsteller customer owner team site the гражданин гражданка г-н г-жа заявитель её его а фамилия имя анкету выдан почта телефон группа по адрес владелец".split())
#: Function words, parts of addresses and labels of numbers; none is half of a name (fixed values).
NO_NAME = frozenset("street avenue lane road drive court rd ct st old north south east west new national insurance for don't it's they've the a an in on at to and or of by with from since until while after before between during halfway following once two if why who her his sur le la les il elle au à l'équipe der die das ein eine und oder von mit für bei im am el los en por que según dni nie nif снилс инн паспорт дом улица пер ул д полис омс водительское удостоверение телефон почта если почему steuer personalausweis reisepass führerschein passeport pasaporte id ssn monsieur madame réf".split())
CUE = re.compile(
    r"""(?ix)(?:\b(?:dear|holder|signed:|please[ ]call|mrs?\.?|ms\.?|dr\.?|herrn?|frau|madame|monsieur|mme|m\.|señora?|sra?\.|don|doña|joindre|llamar[ ]a|antragsteller:|antragstellerin:|filled[ ]in[ ]by|although|appartient[ ]à|pertenece[ ]a|customer|reviewed-by:|\#[ ]ask|author:|owner:|name:|narne:|namc:|nom:|nombre:|имя:|фио:|//[ ]call|call|гражданин|гражданка|заявитель:|на[ ]имя|подписала?|владелец:?)[ ]|values[ ]\(\\?['"]|<name>|^[ ]*['"](?=[^'"]*['"],['"])|^[ ]*(?=[^;@=]{3,60};[A-Z0-9]))$"""
)
AFTER = re.compile(r"""(?ix)^(?:[ ](?:moved[ ]to|lives[ ]at|habite|vive[ ]en|legte|zog|сообщила?|had[ ]left|asked|wohnhaft)|,[ ](?:wohnhaft|проживает|инн|снилс|паспорт|полис)|</name>|[ ]?<[\w.+\-]+(?:@|\(at\)|[ ]\[at\])|['"],[ ]?['"]|;[A-Z0-9])""")


class Names:
    """What is known of names: the lexicon, and endings of surnames learnt from it."""

    def __init__(self, lexicon: list[tuple[str, str]]):
        self.given = {n.lower() for n, k in lexicon if k == "given"}
        self.surnames = {n.lower() for n, k in lexicon if k == "surname"}
        endings = Counter(n[-k:] for n in self.surnames for k in (3, 4))
        clash = Counter(n[-k:] for n in self.given for k in (3, 4))
        self.endings = {e for e, c in endings.items() if c >= 3 and c > 3 * clash[e]} | {"sson", "енко"}

    def surname(self, word: str) -> int:
        """2 in the lexicon, 1 by its ending, 0 unknown; each part of a double name counts."""
        low = word.lower()
        parts = low.split("-")
        if low in self.surnames or any(p in self.surnames for p in parts):
            return 2
        return int(any(len(p) >= 5 and (p[-3:] in self.endings or p[-4:] in self.endings) for p in parts))

    def forename(self, word: str) -> bool:
        return word.lower() in self.given


class Finder:
    def __init__(self, lexicon: list[tuple[str, str]]):
        self.names = Names(lexicon)

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in source places, in order, without overlaps; no value runs over a line end."""
        got = Spans()

        def take(a: int, b: int, kind: str) -> bool:
            return "\n" not in text[a:b] and got.add(a, b, kind)

        base = normalised(text)
        m = undisguised(base)
        if "@" in m.text:
            inside = [x.span() for x in URL.finditer(m.text)] if "://" in m.text else []
            for x in EMAIL.finditer(m.text):
                k = bisect_right(inside, (x.start(), 0)) - 1
                if NO_MAILBOX.match(x.group()) or k >= 0 and inside[k][0] < x.start() <= inside[k][1] or REPOSITORY.match(m.text, x.end()):
                    continue
                take(*m.source(*x.span()), "email")
        spelled = spelled_out(base)
        if DIGIT.search(spelled.text):
            self._numbers(base, spelled, take)
            for x in ADDRESS.finditer(base.text):
                take(*base.source(*x.span()), "street_address")
        if PAIR.search(base.text):
            for pattern in (NAME_LATIN, NAME_RUS):
                if pattern is NAME_RUS and base.text.isascii():
                    continue
                self._named(base, pattern, take)
        return got.all

    def _numbers(self, base: Mapped, spelled: Mapped, take) -> None:
        text = spelled.text
        r = readable(spelled) if FOUR_DIGITS.search(text) else None  # a labelled number has four digits
        numbers = text if text.isascii() else LETTERED.sub(lambda x: x.group().translate(LOOKALIKE), text)  # sign by sign
        at_source = None
        for x in LABEL.finditer(r.text) if r else ():
            if at_source is None:  # where in the text with digits a sign of the source is
                at_source = {b: k + 1 for k, b in enumerate(spelled.ends)}
            at = at_source[r.ends[x.end() - 1]]
            while at < len(text) and text[at] in " \n\t\"'«(":
                at += 1
            v = ID_VALUE.match(numbers, at)
            if v and FOUR_DIGITS.search(v.group()):
                take(*spelled.source(*v.span()), "identity_number")
        for pattern in STRUCTURED if ";" in text or "<" in text or '"' in text or "','" in text else ():
            for x in pattern.finditer(numbers):
                take(*spelled.source(*x.span("v")), "identity_number")
        for x in PHONE.finditer(text):
            if not NO_PHONE.search(text[max(0, x.start() - 20) : x.start()]):
                take(*spelled.source(*x.span()), "phone")
        if spelled is not base:
            for x in SPELLED.finditer(base.text):  # said digit by digit, without groups a number could be known by
                if 7 <= len(re.sub(r"\D", "", _digits(x))) <= 15:
                    take(*base.source(*x.span()), "phone")

    def _named(self, base: Mapped, pattern: re.Pattern, take) -> None:
        text, at = base.text, 0
        while x := pattern.search(text, at):
            a, b = x.span()
            g = x.groupdict()
            words = [w for w in (g["a"], g["b"], g["c"], g["d"], g["e"], g["f"], g["g"]) if w]
            first = words[0].lower()
            if first in TITLES or first in NO_NAME:
                at = a + len(words[0])
                continue
            if words[-1].lower() in NO_NAME:
                at = b
                continue
            sure = 0
            if g["a"]:
                sure = 2 if self.names.forename(g["b"]) else int(self.names.surname(g["a"]) > 0)
            elif g["c"]:
                sure = self.names.surname(g["c"])
            elif g["d"]:
                sure = max(self.names.surname(g["d"]), self.names.surname(g["e"] or ""), 2 * (self.names.forename(g["d"]) and bool(g["e"])))
            else:
                f, h = g["f"], g["g"]
                sure = max(self.names.surname(f), self.names.surname(h))
                known = self.names.forename(f) or self.names.forename(h)
                sure = 2 if known or sure == 2 else sure
            cue = bool(CUE.search(text[max(0, a - 24) : a])) or bool(AFTER.match(text[b : b + 24]))
            if sure == 2 or sure == 1 and (cue or not g["a"]) or cue and not g["a"]:
                take(*base.source(a, b), "name")
                at = b
            else:
                at = a + len(words[0]) if not g["i"] else b
        return


def document_number(value):
    """Column: the whole document number unless it is blank, only filler or a stand-in word."""
    signs = F.regexp_replace(value, r"[<\s\-_.*/\\#?]", "")
    return F.when((F.length(signs) > 0) & signs.rlike(r"[0-9]") & ~signs.rlike("^([0-9A-Za-z])\\1*$"), value)


def lexicon_of(names: DataFrame) -> list[tuple[str, str]]:
    """The lexicon on the driver; it is refused beyond LEXICON_ROWS, which it must fit in to be sent around."""
    rows = names.select("person_name", "name_kind").where(F.col("person_name").isNotNull()).distinct().limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"the name lexicon has more than {LEXICON_ROWS} rows")
    return [(r[0], r[1]) for r in rows]


def find(texts: DataFrame, lexicon: list[tuple[str, str]]) -> DataFrame:
    """(source_table, record_id, pii_kind, pii_value, start, end) of (source_table, record_id, text).

    Values stand exactly as in the text, places are code points, end-exclusive. Null and empty texts have none. Repeated
    rows give repeated rows. Whole texts are read, row by row and without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(lexicon)
        for batch in batches:
            rows = [(s, i, kind, t[a:b], a, b) for s, i, t in zip(batch["source_table"], batch["record_id"], batch["text"]) if t for a, b, kind in finder(t)]
            yield pd.DataFrame(rows, columns=["source_table", "record_id", "pii_kind", "pii_value", "start", "end"])

    return texts.select("source_table", "record_id", "text").mapInPandas(run, "source_table string, record_id long, pii_kind string, pii_value string, start int, end int")


def redact(texts: DataFrame, lexicon: list[tuple[str, str]]) -> DataFrame:
    """(source_table, record_id, redacted): each text with typed placeholders such as [EMAIL]; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(lexicon)
        for batch in batches:
            out = [t and reduce(lambda s, x: f"{s[: x[0]]}[{x[2].upper()}]{s[x[1] :]}", reversed(finder(t)), t) for t in batch["text"]]
            yield batch[["source_table", "record_id"]].assign(redacted=out)

    return texts.select("source_table", "record_id", "text").mapInPandas(run, "source_table string, record_id long, redacted string")
