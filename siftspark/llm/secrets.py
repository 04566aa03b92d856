"""Problem 7: credentials embedded in source code.

Each batch of lines is joined to one text and run once through an Aho-Corasick
automaton of keywords (issuer prefixes, secret-like names, key marks), as it is, without
the separators of names and with its literals glued. Only lines with
a hit are parsed: string literals are read (adjacent or concatenated ones as one),
issuer-format expressions are applied and their structure is validated, and values of
secret-like names are judged by shape. Found secrets are replaced by placeholders of
the same length and alphabet (a hexadecimal value stays hexadecimal), so the line keeps
its syntax. Checksums that an issuer puts into its tokens are computed and reported, not
demanded: many issuers' real tokens carry none.

A line is judged where it is read; only found lines are shuffled, to drop lines that
were delivered twice. Of a private key over several lines the opening line is the
finding; ``redact`` also masks the lines of its body.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.sources.tables import table

# Parts of names that announce a secret (lower case, without separators).
NAMES = ("password", "passwd", "passphrase", "pwd", "smtppass", "dbpass", "userpass", "secret", "apikey", "accesskey", "accountkey", "sharedkey", "signingkey", "encryptionkey", "privatekey", "privatetoken", "accesstoken", "authtoken", "bearer", "credential", "apitoken", "refreshtoken", "sessiontoken", "bottoken", "deploytoken", "accesskeyid")
# Issuer formats: fixed prefixes, then the alphabet and length of the rest.
ISSUERS = (
    r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abeoprs]-[0-9]{8,}-[A-Za-z0-9-]{10,}",
    r"[srp]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"npm_[A-Za-z0-9]{36}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_-]{40,}",
    r"do[opr]_v1_[a-f0-9]{64}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"sk-(?:proj|svcacct|admin)-[A-Za-z0-9_-]{20,}",
    r"sk-ant-[A-Za-z0-9]{2,}-[A-Za-z0-9_-]{20,}",
    r"GOCSPX-[A-Za-z0-9_-]{28}",
    r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}",
    r"xapp-[0-9]-[A-Z0-9]+-[0-9]+-[a-f0-9]{16,}",
    r"whsec_[A-Za-z0-9+/=]{24,}",
    r"lin_api_[A-Za-z0-9]{32,}",
    r"dapi[a-f0-9]{32}",
    r"hvs\.[A-Za-z0-9_-]{24,}",
    r"gl(?:rt|dt|ptt|ft|soat)-[A-Za-z0-9_-]{20,}",
    r"AGE-SECRET-KEY-1[A-Z0-9]{50,}",
    r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}",
    r"sq0(?:csp|atp)-[A-Za-z0-9_-]{22,}",
)
# What the automaton looks for: each expression below needs one of these in the line, as it is or
# without the separators of its names (announces) or with its literals glued (see variants).
WORDS = NAMES + ("akia", "asia", "abia", "acca", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "npm_", "aiza", "sg.", "hf_", "pypi-", "dop_v1_", "eyj", "private key", "://", "pass", "token", "key", "basic", "curl", "wget", "sig=", "login", "user", "cred", "doo_v1_", "dor_v1_", "sk-", "gocspx-", "shpat_", "shpca_", "shppa_", "shpss_", "xapp-", "whsec_", "lin_api_", "dapi", "hvs.", "glrt-", "gldt-", "glptt-", "glft-", "glsoat-", "age-secret-key-1", "pmak-", "sq0csp-", "sq0atp-", "hooks.slack.com/services/", "/api/webhooks/", ":aa")

_ISSUER = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(ISSUERS) + ")")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_HOOK = re.compile(r"hooks\.slack\.com/services/(T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,})|/api/webhooks/\d{10,}/([A-Za-z0-9_-]{40,})|(?<![A-Za-z0-9])(?:bot)?(\d{8,10}:AA[A-Za-z0-9_-]{33})(?![A-Za-z0-9_-])")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s@/\"'`]+)@")
_FIELD = re.compile(r"(?i)(?:password|pwd|accountkey|sharedaccesskey|secret)=([^;\"'`\s]+)(?=;|[\"'`]|\s|$)")
_BASIC = re.compile(r"(?i)\bBasic\s+([A-Za-z0-9+/]{8,}={0,2})")
_BEARER = re.compile(r"(?i)\bBearer\s+([A-Za-z0-9._~+/-]{16,}=*)")
_CURL = re.compile(r"(?:^|\s)(?:-u|--user)[ =]([^\s:\"'`]+):([^\s\"'`]+)")
_QUERY = re.compile(r"(?i)[?&](?:[a-z_]*token|[a-z_]*key|password|secret|sig)=([^&\s\"'`#]+)")
_STRING = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|`((?:[^`\\]|\\.)*)`")
_JOINT = re.compile(r"[\"'`]\s*(?:[+.&]|\.\.|<>|,\s*\\)?\s*\\?\s*[\"'`]")
_GLUE = re.compile(r"\s*(?:[+.,&]|\.\.|<>)?\s*(?:\\)?\s*\Z")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*")
_BARE = re.compile(r"^[\s>|*#/;-]*(?:export\s+|set\s+|ENV\s+|run with\s+)?[`\"']?(?:--|-D)?([A-Za-z_][A-Za-z0-9_.-]*)[`\"']?\s*(?:=>|:=|=|:|\s)\s*(\S.*?)\s*[;,]?\s*$")
_OPTION = re.compile(r"--([A-Za-z][A-Za-z0-9-]*)[= ]([^\s`\"']+)")
_PROSE = re.compile(r"(?i)\b(?:(?:old |new |the |default |admin |root |current )*(?:password|passwd|pwd|passphrase|token|secret|api key|access key)\s+(?:was|is|=|:)|(?:temporary|temp|test|staging|prod|production|master|shared|root|admin|deploy)\s+(?:key|pass|login|creds?|credentials?)\s*[:=]|\b(?:login|user|creds?|credentials?)\s*:\s*[\w.@-]+\s*/|(?:use|with|using)\s+(?:the\s+)?(?:password|token|secret|api key|key))\s+[`\"']?([^\s`\"']+)")
_NETRC = re.compile(r"(?i)\blogin\s+\S+\s+password\s+(\S+)")
_ASSIGN = re.compile(r"([A-Za-z_$][A-Za-z0-9_$.\-]*)[\"']?\]?(?:\s*:\s*[A-Za-z_&][\w:<>\[\] *&?]*?)?(?:\[\])?\s*(?:=>|:=|=|:)\s*(?:&?[A-Za-z_][\w.:]*!?\()?\s*$")
_FAKE = re.compile(
    r"(?i)^(?:$|[x*.•#_\-?0]+$|<.*>$|\$[{(]|\$[A-Za-z_]+$|%[A-Za-z_]+%?$|%\(|\{\{|\{.*\}$|\[.*\]$|\(.*\)$|@[{(]|@[a-z.]+$|#\{|(?:vault|env|ref|secretref|kms|ssm|file|arn|op|keyring|sops|aws-sm)[:/]"
    r"|.*(?:redacted|changeme|change_me|change-me|placeholder|your[_-]|_here\b|dummy|sample_|todo|masked|hidden|removed)|(?:none|null|nil|true|false|undefined|example|test|secret|password|passwd|token|empty|string|str|required|optional|unset|default)$)"
)
# Words of prompts, messages and field names, which a literal beside a password may hold (fixed values).
_LABELS = frozenset("enter your you the is are was must should not for and invalid wrong incorrect missing required optional please new old current confirm repeat again forgot reset change input field label text type hidden plain hash hashed bcrypt scram sha md5 plaintext prompt value name user username login error failed example sample default string number token secret unknown random generated test".split())
_PATHY = re.compile(r"^(?:(?:\.{0,2}/)?[a-z_.-]*(?:/[a-z0-9_.-]+)+|[A-Za-z]:\\.*)$")


def announces(name: str) -> bool:
    """Does a variable or key of this name hold a secret?"""
    n = re.sub(r"[^a-z0-9]", "", name.lower())
    if re.search(r"public(?:key|token)|(?:hash|hashed|sha|sha256|md5|fingerprint|length|count|policy|expiry|ttl|url|uri|path|file)$", n) or re.search(r"[a-z]I[dD]$|[_.-](?i:id)$", name) and not n.endswith("accesskeyid"):
        return False
    return any(x in n for x in NAMES) or n.endswith("token") and n not in ("token",) and _secret_token(name) or n == "token"


def _secret_token(name: str) -> bool:
    return bool(re.search(r"(?i)(?:auth|access|api|bot|private|refresh|session|deploy|csrf|oauth|github|gitlab|npm|slack)[_.-]?token$", name))


def live(value: str, named: bool = True) -> bool:
    """Could this value be a secret in clear (and not a placeholder, mask or reference)?"""
    v = value.strip()
    if _FAKE.match(v) or len(v) < 6 or len(set(v)) < 4 or " " in v or not set(re.sub(r"[\W_]", "", v)) - set("xX0"):
        return False
    if re.search(r"^[A-Za-z_][\w.]*\(|\)$", v) and "(" in v or _PATHY.match(v):
        return False
    digit, sign = bool(re.search(r"\d", v)), bool(re.search(r"[^A-Za-z0-9]", v))
    upper, lower = bool(re.search(r"[A-Z]", v)), bool(re.search(r"[a-z]", v))
    if v.isdigit():
        return False
    return digit or (sign and upper and lower and len(v) >= 8) or (upper and lower and len(v) >= 10 and not re.match(r"^[A-Z]?[a-z]+(?:[A-Z][a-z]+)*$", v)) or (named and sign and len(v) >= 10 and bool(re.search(r"[^\w.-]", v)))


def plain_password(name: str, value: str) -> bool:
    """Is this literal the word, number or phrase that a password-like name holds?

    Only for values that ``live`` cannot tell from ordinary text: they count where the name
    says password, pass phrase or the like, and the value is no label of an input field.
    """
    v = value.strip()
    if not re.search(r"(?i)(?:password|passwd|pwd|passphrase|passcode|pass)$", name) or len(v) < 6 or len(set(v)) < 4 or _FAKE.match(v) or _PATHY.match(v):
        return False
    if re.search(r"[(){}<>$%\[\]:=]", v) or not set(re.sub(r"[\W_]", "", v)) - set("xX0"):
        return False
    low = re.split(r"[\s_.-]+", v.lower())
    if any(w in _LABELS or any(w.startswith(n) for n in ("password", "passwd", "passphrase")) for w in low):
        return False
    return v.isdigit() or bool(re.fullmatch(r"[A-Za-z]{6,}", v)) and not v.isupper() or 3 <= len(low) and bool(re.fullmatch(r"[a-z]+(?:[ -][a-z]+){2,}", v))


def _literals(line: str) -> list[tuple[str, list[int], int]]:
    """String literals as ``(value, positions of its characters, start)``; glued ones are one."""
    out: list[tuple[str, list[int], int]] = []
    last = -1
    for m in _STRING.finditer(line):
        k = next(i for i in (1, 2, 3) if m.group(i) is not None)
        value, at = m.group(k), list(range(m.start(k), m.end(k)))
        if out and last >= 0 and _GLUE.match(line[last : m.start()]) and not re.fullmatch(r"\s*,\s*", line[last : m.start()]) or (out and re.fullmatch(r"\s*,\s*", line[last : m.start()]) and "concat!(" in line[: out[-1][2]]):
            value, at, start = out[-1][0] + value, out[-1][1] + at, out[-1][2]
            out[-1] = (value, at, start)
        else:
            out.append((value, at, m.start()))
        last = m.end()
    return out


def _jwt(v: str) -> bool:
    """Three parts, of which the first is a JSON object with an algorithm or a type."""
    parts = v.split(".")
    if len(parts) != 3 or any(len(p) < 8 for p in parts):
        return False
    try:
        head = json.loads(base64.urlsafe_b64decode(parts[0] + "=" * (-len(parts[0]) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and bool({"alg", "typ", "kid", "enc"} & set(head))


_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(v: str) -> bool:
    """Does the token end with the checksum that its issuer puts there (CRC-32 in base 62)?"""
    m = re.fullmatch(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})", v)
    if not m:
        return False
    crc, out = zlib.crc32(m.group(1).encode()), ""
    while crc:
        crc, r = divmod(crc, 62)
        out = _B62[r] + out
    return out.rjust(6, "0") == m.group(2)


def verified(line: str) -> bool:
    """Does the line hold a token whose checksum or coded structure is right?"""
    return any(checksum(m.group()) or m.group().startswith("eyJ") and _jwt(m.group()) for m in _ISSUER.finditer(line))


def _basic(v: str) -> bool:
    try:
        raw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except ValueError:
        return False
    return b":" in raw and len(raw) >= 5 and all(32 <= c < 127 for c in raw) and live(raw.split(b":", 1)[1].decode(), True)


def spans(line: str) -> list[list[int]]:
    """The positions of the characters of each secret in ``line``; none for a private key whose body is elsewhere."""
    found: list[list[int]] = []

    def take(at: list[int]) -> None:
        if at and not any(set(at) <= set(x) for x in found):
            found.append(at)

    if (m := _PEM.search(line)) and not re.search(r"(?i)[\"'`]\s*(?:in|not in|==|!=)\s|startswith|contains\(|search\(|match\(|grep", line):
        stop = _END.search(line, m.end())
        body = key_chars(line, m.end(), stop.start() if stop else len(line))
        found.append(body if len(body) >= 16 else [])
    texts = [(line, list(range(len(line))))] + [(v, at) for v, at, _ in _literals(line) if len(v) >= 6]
    for text, at in texts:
        for m in _ISSUER.finditer(text):
            v = m.group()
            body = re.sub(r"^[A-Za-z_-]{2,11}[_.-]", "", v)
            if (not v.startswith("eyJ") or _jwt(v)) and len(set(body)) >= 6 and not re.search(r"(?i)x{6}|0{8}|example", v):
                take(at[m.start() : m.end()])
        for m in _HOOK.finditer(text):
            k = next(i for i in (1, 2, 3) if m.group(i))
            if len(set(m.group(k))) >= 8 and not re.search(r"(?i)x{6}", m.group(k)):
                take(at[m.start(k) : m.end(k)])
        for m in _URL.finditer(text):
            if live(m.group(2)) or (not _FAKE.match(m.group(2)) and len(m.group(2)) >= 6 and not m.group(2).isdigit()):
                take(at[m.start(2) : m.end(2)])
        for pattern, ok in ((_FIELD, live), (_BASIC, _basic), (_QUERY, live), (_NETRC, live)):
            for m in pattern.finditer(text):
                if ok(m.group(1)):
                    take(at[m.start(1) : m.end(1)])
        for m in _BEARER.finditer(text):
            if live(m.group(1)) and re.search(r"\d", m.group(1)):
                take(at[m.start(1) : m.end(1)])
        if "curl" in text or "wget" in text:
            for m in _CURL.finditer(text):
                if live(m.group(2)) or (not _FAKE.match(m.group(2)) and len(m.group(2)) >= 6):
                    take(at[m.start(2) : m.end(2)])
    for v, at, start in _literals(line):
        m = _ASSIGN.search(line[:start])
        if m and announces(m.group(1)) and (live(v) or "(" not in m.group() and plain_password(m.group(1), v)) and "://" not in v and ";" not in v:
            take(at)
    for m in _OPTION.finditer(line):
        if announces(m.group(1)) and live(m.group(2)):
            take(list(range(m.start(2), m.end(2))))
    for m in _PROSE.finditer(line):
        v = m.group(1).rstrip(".,;)")
        if live(v, False) and re.search(r"\d|[^\w-]", v):
            take(list(range(m.start(1), m.start(1) + len(v))))
    if (m := _BARE.match(line)) and announces(m.group(1)):
        v = m.group(2)
        if v[:1] in "\"'`" and v[-1:] == v[:1] and len(v) > 1:
            lo, v = m.start(2) + 1, v[1:-1]
        else:
            v = v.rstrip("`")
            lo = m.start(2)
        if not re.search(r"[\"'`\s]", v) and live(v) and "://" not in v and not re.match(r"^[\w.]+[(\[{]|^[\[{]", v):
            take(list(range(lo, lo + len(v))))
    return found


def key_chars(line: str, lo: int, hi: int) -> list[int]:
    """The positions of the coded characters of a key in ``line[lo:hi]``: runs of base 64, not escapes such as a backslash and n."""
    return [i for m in re.finditer(r"\\.|([A-Za-z0-9+/=]{4,})", line[lo:hi]) if m.group(1) for i in range(lo + m.start(1), lo + m.end(1))]


def mask(line: str, found: list[list[int]]) -> str:
    """The line with each secret character replaced by one of the secret's own alphabet.

    Letters and digits of a hexadecimal secret become ``a``, ``A`` and ``0``, those of one in
    base 32 ``A`` and ``2``, all others ``x``, ``X`` and ``0``; other signs stay.
    """
    out = list(line)
    for at in found:
        own = "".join(line[i] for i in at if line[i].isalnum())
        low, up, digit = ("a", "A", "0") if re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", own) else ("a", "A", "2") if re.fullmatch(r"[A-Z2-7]{8,}", own) else ("x", "X", "0")
        for i in at:
            c = line[i]
            out[i] = digit if c.isdigit() else up if c.isupper() else low if c.isalpha() else c
    return "".join(out)


def variants(line: str) -> list[str]:
    """The line in lower case, without the separators of names, and with its literals glued."""
    low = line.lower()
    if not low.isascii():
        low = low.replace("\u017f", "s").replace("\u0131", "i")  # expressions take these for s and i
    bare = low.replace("_", "").replace("-", "").replace(".", "").replace("$", "")
    out = [low] if len(bare) == len(low) else [low, bare]
    if ("'" in low or '"' in low or "`" in low) and (_JOINT.search(low) or "concat!(" in low):
        out.append(re.sub(r"[\"'`]\s*,\s*[\"'`]", "", _JOINT.sub("", low)) if "concat!(" in low else _JOINT.sub("", low))
    return out


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in WORDS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def find(lines: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Lines that hold a secret: ``<keys>, secrets`` (their number), ``verified`` and ``masked`` (the line).

    ``verified``: a checksum or coded structure of one of them is right. The body of a private
    key is masked where it stands on the opening line; see ``redact`` for its other lines.

    Null and empty contents hold nothing; a line delivered twice gives one row; null keys
    are kept as they are; extra columns are ignored; lines of any length are read whole. An
    empty table gives an empty result.
    """
    schema = ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys) + ", secrets int, verified boolean, masked string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = _automaton()
        for f in frames:
            texts = f[content].tolist()
            owner, low = [], []
            for i, t in enumerate(texts):
                for v in variants(t):
                    owner.append(i)
                    low.append(v)
            starts = np.cumsum([0, *(len(t) + 1 for t in low)])[:-1]
            ends = np.fromiter((e for e, _ in auto.iter("\n".join(low))), np.int64)
            hit, out = np.unique(np.asarray(owner, np.int64)[np.searchsorted(starts, ends, "right") - 1]), []
            for i in hit.tolist():
                if found := spans(texts[i]):
                    out.append((i, len(found), mask(texts[i], found)))
            part = pd.DataFrame({k: [f[k].iloc[i] for i, _, _ in out] for k in keys} | {"secrets": [n for _, n, _ in out], "verified": [verified(texts[i]) for i, _, _ in out], "masked": [t for _, _, t in out]})
            if out:
                yield part

    source = lines.select(*keys, content).filter(F.col(content).isNotNull() & (F.length(content) >= 6))
    return source.mapInPandas(run, schema).dropDuplicates(keys)


_HEADER = r"^\W*[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+: "
_BODY = r"^\W*(?:[A-Za-z0-9+/=]+(?:\\[nr])*)?\W*$|" + _HEADER  # one run of base 64, or a header


def key_bodies(lines: DataFrame, file: str = "file_id", order: str = "line_no", content: str = "content") -> DataFrame:
    """The lines between the opening and the closing mark of a private key: ``<file>, <order>, masked``.

    A key whose closing mark is missing ends at the first line that is neither coded data, blank nor
    a header. Only files that hold an opening mark are looked at; a line delivered twice counts once.
    """
    text = F.col(content)
    base = lines.filter(F.col(file).isNotNull() & F.col(order).isNotNull() & text.isNotNull())
    holders = base.filter(text.rlike(_PEM.pattern)).select(file).distinct()
    near = base.join(holders, file, "left_semi").select(file, order, content).dropDuplicates([file, order])
    begin, end = text.rlike(_PEM.pattern), text.rlike(_END.pattern)
    marks = near.withColumns({"__b": F.when(begin & ~end, F.col(order)), "__e": F.when(end, F.col(order)), "__o": F.when(~begin & ~end & ~text.rlike(_BODY), F.col(order))})
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(file).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    placed = marks.withColumns({"__begin": F.max("__b").over(before), "__ended": F.max("__e").over(before), "__odd": F.max("__o").over(before), "__next_end": F.min("__e").over(after), "__next_begin": F.min("__b").over(after)})
    opened = F.col("__begin").isNotNull() & (F.col("__ended").isNull() | (F.col("__ended") < F.col("__begin"))) & F.col("__b").isNull() & F.col("__e").isNull()
    closes = F.col("__next_end").isNotNull() & (F.col("__next_begin").isNull() | (F.col("__next_end") < F.col("__next_begin")))
    runs_on = (F.col("__odd").isNull() | (F.col("__odd") < F.col("__begin"))) & F.col("__o").isNull()
    inside = placed.filter(opened & (closes | runs_on) & ~text.rlike(_HEADER)).select(file, order, content)
    schema = f"{file} {lines.schema[file].dataType.simpleString()}, {order} {lines.schema[order].dataType.simpleString()}, masked string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [mask(t, [key_chars(t, 0, len(t))]) for t in f[content]]
            part = pd.DataFrame({file: f[file], order: f[order], "masked": out})
            part = part[part["masked"] != f[content]]
            if len(part):
                yield part

    return inside.mapInPandas(run, schema)


def redact(lines: DataFrame, file: str = "file_id", order: str = "line_no", content: str = "content") -> DataFrame:
    """Every line that must change, or holds a secret: ``<file>, <order>, secrets, verified, masked``.

    Findings as by ``find``, and the bodies of private keys (``secrets`` is 0 there, since the
    opening line is the finding).
    """
    body = key_bodies(lines, file, order, content).select(file, order, F.lit(0).alias("secrets"), F.lit(False).alias("verified"), "masked")
    hits = find(lines, [file, order], content)
    return hits.join(body.select(file, order), [file, order], "left_anti").unionByName(body)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that hold a secret in clear."""
    return find(table(spark, folder, "source_lines"), ["file_id", "line_no"]).select("file_id", "line_no")


def p7_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Those lines with the secrets masked, and the masked bodies of private keys."""
    return redact(table(spark, folder, "source_lines"))


QUERIES = {"p7_found": p7_found, "p7_masked": p7_masked}
SQL: dict[str, str] = {}
