"""Credentials in source and configuration lines: found and masked.

One deterministic automaton holds every anchor (token prefixes, key armor, names a value is assigned to, headers, options,
commands) together with the grammars of token formats, key armor, connection strings and literals. It runs over
overlapping chunks; absolute places found twice in an overlap count once, and a grammar goes on across the ends of chunks.
The values of assignments and options are read where the automaton found their name, and what is no usable value
(references, placeholders, prompts, digests) is refused. Overlapping spans are settled in favour of the more specific
grammar, and placeholders are spliced in so that the code around stays as it is. Time grows with the length of the text:
nothing is searched backwards over more than the word or line before, and no text is copied.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import CHUNK, Automaton

#: Anchors by kind (fixed values).
PREFIXES = ["akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "sk_test_", "rk_live_", "sk-", "npm_", "pypi-", "aiza", "ya29.", "eyj", "_live_", "hf_", "dop_v1_"]
NAMES = ["password", "passwd", "passphrase", "pass", "pwd", "pw", "secret", "token", "key", "auth", "credential", "credentials", "пароль", "ключ доступа", "секрет", "contraseña", "clave", "mot de passe", "mot_de_passe", "motdepasse", "kennwort", "passwort", "schlüssel", "jeton", "токен"]
OPTIONS = ["-u ", "--user ", "-p", "net use", "sudo -s", "identified by", "://", "bearer ", "basic ", "token ", "client", "session", "signingkey", "tochararray", "publish ", "connect", "login", "apikey", "setpassword"]
COMMANDS = ["mysql", "mariadb", "psql", "mongo", "sshpass", "redis-cli", "docker login", "ldap", "htpasswd", "echo"]
ARMOR = ["-----begin ", "-----end "]
LITERALS = ["="]

#: Grammars by name (fixed values).
GRAMMARS = {
    "key_id": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "token": r"gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{16,}|xox[bpa]-[A-Za-z0-9\-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}|[a-z]{2,5}_live_[A-Za-z0-9]{12,}"
    r"|eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}|AIza[A-Za-z0-9_\-]{30,}|npm_[A-Za-z0-9]{30,}|ya29\.[A-Za-z0-9_\-]{20,}|hf_[A-Za-z0-9]{20,}|dop_v1_[a-f0-9]{40,}|(?:[a-z]{2,8}-)?sk-[A-Za-z0-9_\-]{16,}",
    "armor": r"-----(?:BEGIN|END) [A-Z0-9 ]*-----",
    "userinfo": r"""://[^\s:/@"'?#]*:[^\s"'/]+@[\w\[]""",
    "userinfo_with_slash": r"""://[^\s:/@"'?#]*:[^\s"']+@[\w\[]""",
    "address_token": r"""://[^\s:/@"'?#]{12,}@[\w\[]""",
    "literal": r"""=\s*["'][A-Za-z0-9_\-.+/=~]{20,}["']""",
}

PLACEHOLDER = re.compile(
    r"""(?ix) ^[*•·.#x_\-?]+$ | ^[<\[({].*[>\])}]$ | ^x{3,} | x{4,}-?x* | placeholder | dummy | fake | example | sample | change[-_]?me | redacted | hidden | masked | removed
    | insert | \btodo\b | todo_ | fill[-_ ]?in | do[-_]not[-_]use | goes[-_]here | ^your[-_ ] | your[-_](?:key|token|password|secret|api) | not[-_]a[-_]real | ^(?:none|null|nil|undefined|true|false|yes|no|str|string|int|bytes|bool|password|passwd|secret|token|key|test|tbd|n/a|empty|never|required|optional)$"""
)
REFERENCE = re.compile(r"^(?:\$|%\(|%[sdA-Z]|\{\{|\$\{|<|@|env[.:\[(]|vault[.:]|ref\+|arn:|!|&(?![A-Za-z0-9]*[0-9]))|\$\{|\$\(|\{\{|^[A-Za-z_][\w.]*\(|^(?:self|this|os|settings|config|process|env|secrets?|vault|app|ctx|opts|args|params|conf)\.[A-Za-z_]|^[A-Za-z_]\w*\[|^https?://|^/|^\.{1,2}/|^sqlite:|^(?:file|jdbc|postgres\w*|mysql|mongodb\S*|redis|amqp)://")
DIGEST_NAME = re.compile(r"(?i)(?:sha\d*|md5|hash|digest|checksum|etag|integrity|commit|revision|\brev|request[_-]?id|trace[_-]?id|uuid|object[_-]?id|build[_-]?id|fingerprint)\W{0,4}(?:sha\d+[-:])?$")
PLAIN_NAME = re.compile(r"(?i)(?:sort|primary|foreign|public|partition|cache|row|index|unique|map|group|order|routing|object|file|s3|hot|short|arrow|enter|tab|ssh|host|dict|json|node|next|page|cancellation|csrf|end|start|pad|unk|eos|bos|mask|sep|cls|tokenizer)[_.\- ]?(?:key|token)$|^(?:label|hint|prompt|placeholder|reset|forgot|text|title|message|error)[._]|keyword|monkey|hotkey|turkey|donkey|compass$|bypass$|encompass$|trespass$|surpass$|author$|tokenize")
GIVEN = re.compile(r"""(?:\\?["'`]|\])*\)?[ \t]*(?P<sign>:=|=>|===?|!==?|[:=]|\bis\b|\blautet\b|\best\b|\bes\b|->)[ \t]*\(?(?:[a-z]{0,2}(?P<q>\\?["'`])(?P<quoted>[^"'`\n]*?)(?P=q)|(?P<bare>[^\s"'`,;&<]{4,}|[^\s"'`,]{1,4096}))""")
SPOKEN = re.compile(r"(?:[ \t]+(?:for|für|pour|para|de|для|of|к|von|du)[ \t]+|[ \t]+)[\w\-]+(?:[ \t]+(?:is|lautet|est|es)[ \t]+|[ \t]*[:=][ \t]*)(?P<bare>[^\s\"'`,]+)")
XML = re.compile(r">(?P<bare>[^<>\s]+)</")
SPACED = re.compile(r"[ \t]+(?P<bare>[^\s\"'`,;]{8,})")
QUOTED_ARG = re.compile(r"""["'](?P<quoted>[^"'\n]{6,})["']""")
B64 = re.compile(r"[A-Za-z0-9+/_\-]{8,}={0,2}")
#: Lines of a key that has no END line (fixed value).
KEY_BODY = re.compile(r"(?:(?:\\[nr]|[\s\"'+,])*(?:[A-Za-z][A-Za-z\-]+: [^\n\\]*(?:\\[nr]|\n)+)*[A-Za-z0-9+/=]{16,})+(?:(?:\\[nr]|[\r\n])+[A-Za-z0-9+/]+={1,2})?")
TOKEN = r"[A-Za-z0-9_\-.+/=~]{16,}"
LONE = re.compile(rf"(?<![\w\-./+=])(?P<bare>{TOKEN})(?![\w\-])")


#: Short parts of names (fixed values).
SHORT_WORDS = {"a", "an", "as", "at", "by", "db", "do", "go", "id", "ids", "if", "in", "io", "ip", "is", "it", "my", "no", "of", "on", "or", "os", "to", "ui", "up", "pw", "pwd", "psw", "pass", "cfg", "ctx", "msg", "str", "ptr", "txt", "url", "uri", "ssh", "ssl", "tls", "ftp", "http", "https", "html", "xml", "sql", "mysql", "ldap", "smtp", "srv", "svc", "mgr", "btn", "tmp", "rds", "aws", "dns", "jwt", "kms"}


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def random_looking(s: str) -> bool:
    """Long, of mixed signs, and no words, path, host, version, or UUID."""
    if len(s) < 16 or not re.search(r"[0-9]", s) or not re.search(r"[A-Za-z]", s) or entropy(s) < 3.0:
        return False
    if re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s) or re.fullmatch(r"[a-z]+(?:[-_./][a-z]+)*[-_.]?\d{0,4}", s):
        return False
    return len(re.findall(r"[a-z]{6,}|[A-Z][a-z]{5,}", s)) == 0 or entropy(s) > 4.2


def _mixed(value: str) -> bool:
    """Eight letters or more in mixed case, two parts of which are no words of a camel-case name."""
    if not re.fullmatch(r"[A-Za-z]{8,}", value) or value.isupper() or value[1:].islower():
        return False
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", value)
    return sum(p.lower() not in SHORT_WORDS and (len(p) <= 2 or not re.search(r"(?i)[aeiouy]", p) or re.match(r"(?i)[bcdfghjklmnpqrstvwxz]{3}(?<!str)(?<!spr)(?<!scr)(?<!spl)(?<!sch)(?<!shr)(?<!thr)(?<!chr)(?<!phr)", p) is not None) for p in parts) >= 2


def usable(value: str, quoted: bool, password: bool = False) -> bool:
    """A value that can be used as it stands, and not a reference, a prompt or a stand-in."""
    if len(value) < 4 or REFERENCE.search(value) or PLACEHOLDER.search(value):
        return False
    if re.search(r"\s", value) or value.isdigit() and len(value) < 6:
        return False
    if re.fullmatch(r"[A-Za-z]+(?:[-_.][A-Za-z]+)*", value) and not (re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value) and entropy(value) > 3.0 and len(value) >= 8) and not (password and _mixed(value)):
        return False  # words only: the name of an object, a field or a file
    if re.search(r"[()\[\]{}]", value) and not quoted and re.search(r"\w[(\[{]\S*|^[)\]}]", value) and not re.search(r"[!@#$%^&*]", value):
        return False
    return len(set(value)) > 2


QUOTES = frozenset("\"' \t\n\r")
ONE_NAME = 200  # the last signs of a name that tell what it names
TAIL = re.compile(r"(?i)(?:[_\-]?(?:value|str|id|base64|b64|hash|phrase|s))?(?![\w])")
SENTENCE = re.compile(r"[ \t]+[a-zа-я]+[ \t]+[a-zа-я]+")
OPTION_USER = re.compile(r"""\s*["']?[\w.\-@]+:(?P<pw>[^\s"']+)""")
OPTION_PASSWORD = re.compile(r"""(?:\s*(["'])(?P<quoted>[^"'\n]+)\1|(?P<bare>[^\s"']+)|\s+(?P<next>[^\s"']+))""")
SHARE = re.compile(r"""(?i)\s+\S+\s+\\\\\S+\s+(?P<pw>\S+)\s+/user:""")
ECHO = re.compile(r"""(?i)echo\s+(["']?)(?P<pw>[^"'\s|]+)\1\s*\|\s*""")
HEADER_VALUE = re.compile(r"\s*(?P<bare>[A-Za-z0-9_\-.+/=~]{8,})(?![({])")
CALL = re.compile(r"[\w.:]*\((?P<args>[^()\n]*)\)")


def _back(text: str, at: int, member) -> int:
    """The start of the run of such signs that ends at this place."""
    while at and member(text[at - 1]):
        at -= 1
    return at


def _header_before(text: str, at: int) -> bool:
    """Whether the word before, over one to eight signs, names an authorization header, or an option's dashes stand there."""
    if text[max(0, at - 2) : at] == "--":
        return True
    end = at
    while end and at - end < 8 and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    if end == at or not end:
        return False
    start = max(_back(text, end, lambda c: c.isalnum() or c in "_-"), end - ONE_NAME)
    return re.search(r"(?i)auth|header|proxy", text[start:end]) is not None


class Spans:
    """Spans taken without overlaps."""

    def __init__(self, spans: list[tuple[int, int, str]] | None = None):
        self.all = spans or []

    def add(self, a: int, b: int, kind: str) -> bool:
        k = bisect_left(self.all, (a, b))
        if k and self.all[k - 1][1] > a or k < len(self.all) and self.all[k][0] < b:
            return False
        insort(self.all, (a, b, kind))
        return True


class Credentials:
    def __init__(self):
        self.automaton = Automaton({"prefix": PREFIXES, "name": NAMES, "option": OPTIONS, "armor": ARMOR, "command": COMMANDS, "literal": LITERALS}, GRAMMARS)

    def _armor(self, text: str, places: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(private keys, all armored blocks), each from its BEGIN line on; a key without END reaches as far as its body."""
        begins, ends = [], {}
        for at in places:
            if got := self.automaton.read(text, at).get("armor"):
                line = text[at : got[1]]
                if line[5] == "B":
                    begins.append((at, got[1], line[11:-5]))
                else:
                    ends.setdefault(line[9:-5], []).append((at, got[1]))
        every = sorted(x for some in ends.values() for x in some)
        keys, blocks = [], []
        for n, (start, body, kind) in enumerate(begins):
            own = ends.get(kind, [])
            k = bisect_left(own, (body,))
            last = None
            if "PRIVATE KEY" in kind:
                following = begins[n + 1][0] if n + 1 < len(begins) else len(text) + 1
                if k < len(own) and own[k][0] < following:
                    last = own[k][1] if sum(not c.isspace() for c in text[body : own[k][0]].replace("\\n", "")) >= 16 else None
                elif m := KEY_BODY.match(text, body):
                    last = m.end()
                if last:
                    keys.append((start, last))
            k = bisect_left(every, (body,))
            if last or k < len(every):
                end = last or every[k][1]
                if not blocks or start >= blocks[-1][1]:
                    blocks.append((start, end))
        return keys, blocks

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of every credential, without overlaps, in order."""
        out: list[tuple[int, int, int, str]] = []  # rank (smaller is more specific), start, end, kind
        read = self.automaton.read

        def take(rank: int, start: int, end: int, kind: str, quoted: bool = False, trusted: bool = False) -> None:
            value = text[start:end]
            if not quoted:
                cut = value.rstrip(";,.)>") if not trusted else value
                end, value = start + len(cut), cut
            if value and (trusted and not PLACEHOLDER.search(value) or not trusted and usable(value, quoted, kind == "password")):
                out.append((rank, start, end, kind))

        anchors = self.automaton.anchors(text)
        keys, blocks = self._armor(text, [a for a, _, _, kind in anchors if kind == "armor"])
        out += [(0, a, b, "private_key") for a, b in keys]
        addresses = [a for a, _, word, _ in anchors if word == "://"]
        block = token_end = 0
        run_start = seen = 0  # where the name around the last anchor begins, and up to where that is known
        line_end, commands = 0, {}  # the commands of the line read so far
        for start, end, word, kind in anchors:
            while block < len(blocks) and blocks[block][1] <= start:
                block += 1
            if kind == "armor" or block < len(blocks) and blocks[block][0] <= start:
                continue
            if kind in ("command", "option") and start >= line_end:
                line_end, commands = (text.find("\n", start) + 1 or len(text) + 1), {}
            if kind == "prefix":
                begin = start
                while begin and begin > start - 10 and (text[begin - 1].isalnum() or text[begin - 1] in "-_"):
                    begin -= 1
                for at in dict.fromkeys((begin, start)) if start >= token_end else ():
                    if at and text[at - 1].isalnum():
                        continue
                    got = read(text, at)
                    last = got["token"][1] if "token" in got else got["key_id"][1] if "key_id" in got and not text[got["key_id"][1] : got["key_id"][1] + 1].isalnum() else None
                    if last:
                        if not PLACEHOLDER.search(text[at:last]):
                            out.append((1, at, last, "token"))
                            token_end = last
                        break
            elif kind == "name":
                begin = start
                while begin > seen and (text[begin - 1].isalnum() or text[begin - 1] in "_-.$"):
                    begin -= 1
                run_start, seen = run_start if begin <= seen else begin, max(seen, start)
                self._named(text, run_start, start, end, word, take)
            elif kind == "command":
                if start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_"):
                    if word in ("mysql", "mongo", "ldap") or not (text[end : end + 1].isalnum() or text[end : end + 1] == "_"):
                        commands[word] = start
            elif kind == "literal":
                if text[end : end + 1] in QUOTES and (got := read(text, start).get("literal")):
                    self._literal(text, start, got[0], take)
            else:
                self._option(text, start, end, word, take, commands, addresses)
        out.sort(key=lambda x: (x[0], x[1], -x[2]))
        kept = Spans()
        for _, a, b, kind in out:
            kept.add(a, b, kind)
        return kept.all

    @staticmethod
    def _literal(text: str, start: int, end: int, take) -> None:
        """A quoted random value given to a variable of any name but that of a digest."""
        a = start + 1
        while text[a] not in "\"'":
            a += 1
        value = text[a + 1 : end - 1]
        name = _back(text, start, lambda c: c in " \t")
        name = text[max(_back(text, name, lambda c: c.isalnum() or c in "_-.:/"), name - ONE_NAME) : name]
        if random_looking(value) and not DIGEST_NAME.search(name) and not re.match(r"sha\d+-", value):
            take(5, a + 1, end - 1, "token", quoted=True)

    @staticmethod
    def _named(text: str, begin: int, start: int, end: int, word: str, take) -> None:
        after = text[end : end + 1]
        dashes = text[begin : begin + 2] == "--" or text[max(0, begin - 2) : begin] == "--"
        begin = max(begin, end - ONE_NAME)
        tail = TAIL.match(text, end)
        whole = text[begin:end]
        if not tail or PLAIN_NAME.search(whole):
            return
        suffix = tail.group().lower().strip("_-")
        if suffix in ("hash", "id") and not re.search(r"(?i)access[_-]?key$", whole):
            return
        if word in ("pass", "pw", "key", "auth", "token", "pwd") and start > begin and text[start - 1].isalpha() and not (text[start].isupper() and text[start - 1].islower()) and not whole[: start - begin].isupper() and not re.search(r"(?i)(?:api|secret|access|auth|oauth|db|user|signing|private|my|root|admin)$", whole[: start - begin]):
            return
        end = tail.end()
        m = GIVEN.match(text, end)
        if m is None and after == ">":
            m = XML.match(text, end)
        strict = word in ("key", "auth", "token", "secret", "clave", "schlüssel", "ключ доступа", "jeton", "credential", "credentials", "токен", "секрет")
        if m is None and (word not in ("pass", "pw", "key", "auth") or word == "key" and re.search(r"(?i)secret|access|api|sign", whole)):
            env = SPACED.match(text, end)
            before = _back(text, begin, lambda c: c in " \t")
            if env and (dashes or before < begin and text[max(0, before - 3) : before].lower() == "env" and (before == 3 or not (text[before - 4].isalnum() or text[before - 4] == "_"))):
                m = env
            elif env and re.fullmatch(r"(?i).*(?:secret|api|access)[_-]?key", whole) and random_looking(env["bare"]):
                m = env
            else:
                m = SPOKEN.match(text, end)
        if m is None:
            return
        quoted = "quoted" in m.groupdict() and m.group("quoted") is not None
        a, b = m.span("quoted" if quoted else "bare")
        value = text[a:b]
        header = re.match(r"(?i)(?:bearer|basic|token)\s+", value) if quoted else re.fullmatch(r"(?i)bearer|basic|token", value)
        if header:
            return  # the header's own grammar reads it
        if not quoted and (cut := re.search(r"[;&<]|\\n", value)) and cut.start() >= 4:
            b = a + cut.start()
            value = text[a:b]
        if not quoted and "==" in (m.groupdict().get("sign") or ""):
            return  # a comparison with another variable
        if strict and re.fullmatch(r"[A-Za-z]+(?:[-_.][A-Za-z]+)*", value.rstrip(";,")) and not random_looking(value):
            return
        if strict and len(value) < 8:
            return
        if word == "key" and not (random_looking(value) or re.search(r"(?i)api|secret|access|sign|private|encrypt|auth", whole)):
            return
        if not quoted and SENTENCE.match(text, b) and re.fullmatch(r"\w+", value) and not re.search(r"\d", value):
            return  # a sentence about the name, not a value
        take(3, a, b, "password" if not strict else "token", quoted)

    def _option(self, text: str, start: int, end: int, word: str, take, commands: dict[str, int], addresses: list[int]) -> None:
        bounded = start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "-")
        if word == "://":
            k = bisect_right(addresses, start)
            limit = addresses[k] if k < len(addresses) else len(text)
            got = self.automaton.read(text, start, limit) if text.find("@", end, limit) > 0 else {}
            if whole := got.get("userinfo"):
                take(2, text.index(":", start + 3) + 1, whole[1] - 2, "connection_string", quoted=True)
            elif whole := got.get("userinfo_with_slash"):
                take(2, text.index(":", start + 3) + 1, whole[0] - 2, "connection_string", quoted=True)
            elif (whole := got.get("address_token")) and random_looking(text[start + 3 : whole[1] - 2]):
                take(2, start + 3, whole[1] - 2, "token", quoted=True)
        elif word in ("-u ", "--user ") and bounded:
            m = OPTION_USER.match(text, end)
            if m:
                take(2, *m.span("pw"), "password", quoted=True)
        elif word == "-p" and bounded:
            m = OPTION_PASSWORD.match(text, end)
            if m and commands.keys() - {"echo"}:
                if m["next"] and not commands.keys() & {"sshpass", "docker login", "mongo"}:
                    return
                take(2, *m.span("quoted" if m["quoted"] else "bare" if m["bare"] else "next"), "password", quoted=True)
        elif word == "net use":
            m = SHARE.match(text, end)
            if m:
                take(2, *m.span("pw"), "password", quoted=True)
        elif word == "sudo -s":
            m = ECHO.fullmatch(text, commands["echo"], start) if "echo" in commands else None
            if m:
                take(2, *m.span("pw"), "password", quoted=True)
        elif word == "identified by":
            m = QUOTED_ARG.match(text, end + 1)
            if m:
                take(2, *m.span("quoted"), "password", quoted=True)
        elif word in ("bearer ", "basic ", "token ") and _header_before(text, start) and bounded | (text[start - 2 : start] == "--"):
            m = HEADER_VALUE.match(text, end)
            if m:
                take(2, *m.span("bare"), "basic" if word == "basic " else "token", trusted=bool(re.search(r"[0-9A-Z]", m["bare"])))
        elif word == "tochararray":
            if start > 5 and text[start - 1] == "." and text[start - 2] in "\"'":
                a = _back(text, start - 2, lambda c: c not in "\"'\n")
                if a and text[a - 1] in "\"'" and start - 2 - a >= 4:
                    take(2, a, start - 2, "password", quoted=True)
        elif word == "publish ":
            m = LONE.match(text, end)
            if m and random_looking(m["bare"]):
                take(4, *m.span("bare"), "token")
        elif word in ("client", "session", "signingkey", "connect", "login", "apikey", "setpassword"):
            m = CALL.match(text, end)
            if m:
                for q in QUOTED_ARG.finditer(text, *m.span("args")):
                    v = q["quoted"]
                    if random_looking(v) or re.fullmatch(r"[0-9a-f]{32,}", v):
                        take(4, *q.span("quoted"), "token", quoted=True)


def alone(text: str) -> tuple[int, int, str] | None:
    """The credential that a matched text is, where the line it came from is not known: no name tells it, only its form."""
    m = re.fullmatch(r"(?i)(?:token|bearer|basic)\s+(?P<v>[A-Za-z0-9_\-.+/=]{16,})|<?password>(?P<v2>[^\s<>]{5,})(?:</\w*>?)?|[a-z][\w\-]*:(?P<v3>(?=\S*\d)[^\s:/()]{6,24})", text)
    if m:
        k = next(k for k, v in m.groupdict().items() if v)
        return (m.start(k), m.end(k), "token" if k == "v" else "password") if usable(m[k], True) else None
    m = re.fullmatch(r"""\s*(?:-p)?["'`]?(?P<v>[^\s"'`:=(){}<>/,;]{8,}|[A-Za-z0-9+/]{40})["'`]?\s*""", text)
    if not m:
        return None
    v = m["v"]
    if PLACEHOLDER.search(v) or REFERENCE.search(v) or re.fullmatch(r"[0-9a-fA-F\-]+|[A-Z0-9]+|[\d\W_]+", v) or re.search(r"@[\w\-]*\.[a-z]{2,}|^@|\.[a-z]{2,4}$", v):
        return None
    password = len(v) <= 24 and re.search(r"[a-z]", v) and re.search(r"\d", v) and (re.search(r"[!@#$%^&*~+]", v) or re.fullmatch(r"[a-z]+(?:-[a-z]+){2,}-\d+", v) or re.fullmatch(r"[A-Z]?[a-z0-9]{8,}", v) and len(re.findall("[a-z]", v)) >= 5)
    if password or random_looking(v):
        return m.start("v"), m.end("v"), "password" if password else "token"
    return None


_finders: list[Credentials] = []


def _shared() -> Credentials:
    if not _finders:
        _finders.append(Credentials())
    return _finders[0]


def _all(finder: Credentials, text: str, bare: bool) -> list[tuple[int, int, str]]:
    spans = finder.spans(text)
    lone = alone(text) if bare and not spans else None
    return [lone] if lone else spans


def find(df: DataFrame, id_col: str, text_col: str, fallback_col: str | None = None) -> DataFrame:
    """(id, start, end, kind, secret): every credential in the text, or in the fallback column where the text is null.

    Offsets are code points, end-exclusive. The same value standing twice is found twice, each with its place. Null and
    empty texts have none. Whole texts are read, row by row and without a shuffle; only the named columns are read.
    """
    source = F.coalesce(F.col(text_col), F.col(fallback_col)) if fallback_col else F.col(text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _shared()
        for batch in batches:
            rows = [(i, a, b, kind, t[a:b]) for i, t, bare in zip(batch["id"], batch["text"], batch["bare"]) if t for a, b, kind in _all(finder, t, bare)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "kind", "secret"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), source.alias("text"), F.col(text_col).isNull().alias("bare")).mapInPandas(run, f"id {kind}, start int, end int, kind string, secret string").withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str, text_col: str, fallback_col: str | None = None) -> DataFrame:
    """(id, redacted, n_secrets): each text with only its credentials replaced by [kind]; null stays null."""
    source = F.coalesce(F.col(text_col), F.col(fallback_col)) if fallback_col else F.col(text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _shared()
        for batch in batches:
            out, counts = [], []
            for t, bare in zip(batch["text"], batch["bare"]):
                spans = _all(finder, t, bare) if t else []
                if spans:
                    cuts = [0, *(x for a, b, _ in spans for x in (a, b)), len(t)]
                    kept = [t[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
                    t = kept[0] + "".join(f"[{kind}]{rest}" for (_, _, kind), rest in zip(spans, kept[1:]))
                out.append(t)
                counts.append(len(spans))
            yield pd.DataFrame({"id": batch["id"], "redacted": out, "n_secrets": counts})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), source.alias("text"), F.col(text_col).isNull().alias("bare")).mapInPandas(run, f"id {kind}, redacted string, n_secrets int").withColumnRenamed("id", id_col)
