"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Method: a random forest on candidate length, character transitions, dictionary coverage, path and
neighbouring words, trained from labelled findings.  The corpus tables hold no labelled findings, so
`labelled_findings` makes a seeded set: published token formats as positives, and look-alikes
(checksums, commits, UUIDs, paths, identifiers, encoded images) as negatives.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._forest import Forest, fit
from ._tokens import small

CANDIDATE = re.compile(r"[A-Za-z0-9_+/.\-]{16,}={0,2}")
#: Words that make up identifiers and paths.
DICTIONARY = (
    "access account action admin alpha array asset async audio author backup banner batch beta binary block "
    "branch bucket buffer build button cache category chapter character class client cloud code column command comment "
    "common config connect content context control cookie core count create data database date debug default delete "
    "detail device digest document domain download draft driver editor element email engine entry error event example "
    "export factory feature field file filter final folder font footer format frame function gallery game gateway "
    "global graph group handler header helper history home host html image import index info input install instance "
    "interface internal item java kernel label language large layer layout level library license light link list local "
    "locale login main manager master media member memory menu message method metric migration mobile model module "
    "monitor name network node note number object office option order output package page panel parameter parent parser "
    "partition password path payment photo plugin point policy post preview price print private process product profile "
    "project property provider public query queue random range record release remote report request resource response "
    "result return review role route sample schema screen script search section security select sequence server service "
    "session setting shared simple single small source space spark static status storage stream string style submit "
    "summary support switch system table target task template test text theme thumb time title token tool topic total "
    "trace type update upload user utils value vendor version video view volume web widget window wrapper"
).split()
ASKING = frozenset("token key secret password passwd pwd apikey api auth bearer credential credentials access private".split())
TELLING = frozenset("sha sha1 sha256 md5 commit checksum digest hash etag uuid guid revision build image version integrity id path file url".split())
#: An asking word with what may stand between it and its value.
ASK = re.compile(r"(?i)(?<![A-Za-z])(?:token|key|secret|password|passwd|pwd|apikey|api|auth|bearer|credentials?|access|private)(?![A-Za-z0-9_])[\"'\]]{0,2}(?:\s*[:=]+>?\s*|\s+)")
_BARE = re.compile(r"[^\s&]+")
#: A private key in text form is one candidate, from its first line to its last.
BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s,:\-\\]*?-----END [A-Z ]{0,40}PRIVATE KEY-----")
#: Kinds of characters, by whose sequence transitions are counted.
KINDS = "digit", "upper", "lower", "mark"
FEATURES = ("length", "digits", "upper", "lower", "marks", "entropy", "switches", "runs", "hex", "covered", "slashes", "dots", "dashes", "extension", "path_before", "asking", "telling", "assigned", "quoted", "prefix", "unusual", "likelihood", "block", *(f"{a}_{b}" for a in KINDS for b in KINDS))
_PREFIX = re.compile(r"(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|eyJ)")
_EXTENSION = re.compile(r"\.[a-z]{1,5}$")
_WORD = re.compile(r"[a-z0-9]+")


@cache
def _dictionary() -> re.Pattern:
    return re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)))


@cache
def _pairs() -> frozenset:
    return frozenset(w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1))


@cache
def _transitions() -> dict[str, float]:
    """Log probability of each letter after another in the dictionary's words, every pair counted once more."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    count = {a: dict.fromkeys(letters, 1) for a in letters}
    for w in DICTIONARY:
        for a, b in zip(w, w[1:]):
            count[a][b] += 1
    return {a + b: math.log(n / sum(row.values())) for a, row in count.items() for b, n in row.items()}


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(before: str, candidate: str, after: str) -> list[float]:
    """The features named in `FEATURES`; ``before`` and ``after`` are the neighbouring text."""
    n = len(candidate)
    kinds = [_kind(c) for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    counts = [candidate.count(c) for c in set(candidate)]
    near = _WORD.findall(before.lower())[-3:] + _WORD.findall(after.lower())[:2]
    tail = before.rstrip()
    pairs = [x for x in map("".join, zip(candidate.lower(), candidate[1:].lower())) if x.isalpha()]
    likely = [p for x in pairs if (p := _transitions().get(x)) is not None]
    steps = [0] * 16
    for a, b in zip(kinds, kinds[1:]):
        steps[4 * a + b] += 1
    return [
        n,
        *share,
        -sum(c / n * math.log2(c / n) for c in counts),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        sum(a == b for a, b in zip(candidate, candidate[1:])) / max(1, n - 1),
        sum(c in "0123456789abcdefABCDEF" for c in candidate) / n,
        sum(len(m) for m in _dictionary().findall(candidate.lower())) / n,
        candidate.count("/"),
        candidate.count("."),
        candidate.count("-"),
        bool(_EXTENSION.search(candidate)),
        bool(re.search(r"[:/\\]$|www\.?$", before)),
        sum(w in ASKING for w in near),
        sum(w in TELLING for w in near),
        tail.rstrip("\"'").rstrip().endswith(("=", ":")),
        before.endswith(('"', "'")),
        bool(_PREFIX.match(candidate)),
        sum(x not in _pairs() for x in pairs) / max(1, len(pairs)),
        sum(likely) / max(1, len(likely)),
        candidate.startswith("-----BEGIN "),
        *[k / max(1, n - 1) for k in steps],
    ]


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of what follows an asking word: a quoted string, or else everything up to white space or ``&``."""
    for m in ASK.finditer(text):
        s = m.end()
        quote = text[s : s + 1]
        if quote and quote in "\"'`":
            s += 1
            e = text.find(quote, s)
            line = text.find("\n", s, e) if e >= 0 else 0
            if e > s and line < 0:
                yield s, e
                continue
        bare = _BARE.match(text, s)
        if bare and (x := bare.group().rstrip(",;.)]}\"'`")):
            yield s, s + len(x)


def candidates(text: str, window: int = 40) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, text before, candidate, text after, in order.

    A candidate is what follows an asking word, of any length and characters, or anywhere 16 or more
    characters of tokens with a digit and a letter, or a private key's block of lines.  One may lie within
    another, but none within a block.
    """
    blocks = [m.span() for m in BLOCK.finditer(text)] if "PRIVATE KEY-----" in text else []
    found = set(_values(text))
    for m in CANDIDATE.finditer(text):
        x = m.group().rstrip(".-")
        if len(x) >= 16 and any(c.isdigit() for c in x) and any(c.isalpha() for c in x):
            found.add((m.start(), m.start() + len(x)))
    if blocks:
        found = {(s, e) for s, e in found if not any(s < y and x < e for x, y in blocks)} | set(blocks)
    for s, e in sorted(found):
        yield s, e, text[max(0, s - window) : s], text[s:e], text[e : e + window]


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label), half of them secrets."""
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, k: "".join(rng.choices(chars, k=k))
    hexa = lambda k: draw("0123456789abcdef", k)
    word = lambda: rng.choice(DICTIONARY)
    prose = lambda k: " ".join("".join(rng.choices(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "ation", "le", "de"), k=rng.randint(1, 4))) for _ in range(k))
    asks = ("token", "api_key", "secret", "password", "auth_token", "access_key", "private_key", "client_secret", "credential")
    good = (lambda: hexa(40), lambda: hexa(32), lambda: hexa(64), lambda: "AKIA" + draw(alnum[:26] + "234567", 16), lambda: "ghp_" + draw(alnum, 36), lambda: draw(alnum, rng.randint(20, 48)), lambda: "xoxb-" + draw("0123456789", 12) + "-" + draw(alnum, 24), lambda: "eyJ" + draw(alnum, 60) + "." + draw(alnum, 40), lambda: base64.b64encode(rng.randbytes(rng.randint(24, 40))).decode(), lambda: "sk_live_" + draw(alnum, 24))
    marks = "!@#$%^&*-_+?~"
    letters = alnum[:52]
    chosen = (
        lambda: draw(letters, rng.randint(8, 24)),
        lambda: draw(alnum + marks, rng.randint(7, 15)),
        lambda: word().capitalize() + draw("0123456789", rng.randint(1, 4)) + draw(marks, rng.randint(1, 2)),
        lambda: "".join(c if rng.random() < 0.7 else {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(c, c.upper()) for c in word() + word()) + draw(marks, 1) + draw("0123456789", rng.randint(1, 3)),
    )
    # what follows an asking word and is no secret: prose, names of things, placeholders, lookups
    plain = (
        lambda: word(),
        lambda: prose(1),
        lambda: prose(rng.randint(2, 6)),
        lambda: rng.choice(("null", "None", "true", "false", "required", "string", "optional", "is", "of", "to", "for", "the", "and", "=", "-", "(", "|")),
        lambda: rng.choice(("${", "{{", "$", "%", "<", "os.environ[", "getenv(", "self.", "config.")) + word().upper() + rng.choice(("}", "_" + word().upper(), ">", ")", "")),
        lambda: rng.choice("*x.-") * rng.randint(3, 12),
        lambda: f"your_{word()}_here",
        lambda: word() + rng.choice((",", "-", "_", "/", "'s ", ".")) + word(),
        lambda: str(rng.randint(0, 9999)),
    )
    wrapped = lambda x: "\n".join(x[i : i + 64] for i in range(0, len(x), 64))

    def block() -> str:
        kind = rng.choice(("", "RSA ", "EC ", "OPENSSH "))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{wrapped(base64.b64encode(rng.randbytes(rng.randint(60, 300))).decode())}\n-----END {kind}PRIVATE KEY-----"

    def sample() -> str:
        """What stands between such lines in instructions."""
        kind = rng.choice(("", "RSA ", "EC "))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{rng.choice((prose(4), '', 'your key here', 'MII', word() * 3))}\n-----END {kind}PRIVATE KEY-----"

    uuid = lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12))
    bad = (
        lambda: (rng.choice(("commit ", "revision ", "sha1: ", "commit: ")), hexa(40)),
        lambda: (rng.choice(("md5 ", "checksum: ", "md5=", "etag: \"")), hexa(32)),
        lambda: (rng.choice(("sha256 ", "digest: ", "sha256:")), hexa(64)),
        lambda: (rng.choice(("uuid ", "id = \"", "guid: ", "")), uuid()),
        lambda: (rng.choice(("file ", "path: ", "", "in ")), "/".join(word() for _ in range(rng.randint(2, 5))) + f"/{word()}{rng.randint(0, 99)}.{rng.choice(('py', 'java', 'html', 'png', 'json'))}"),
        lambda: (rng.choice(("http://", "https://www.", "url: ")), f"{word()}{rng.randint(1, 99)}.example.com/{word()}/{word()}-{rng.randint(1, 9999)}"),
        lambda: (rng.choice(("", "call ", "key: ", "token = ")), "_".join(word() for _ in range(rng.randint(3, 5))) + str(rng.randint(0, 99))),
        lambda: (rng.choice(("", "new ", "class ")), "".join(word().capitalize() for _ in range(rng.randint(3, 5))) + str(rng.randint(0, 9))),
        lambda: (rng.choice(("image/png;base64,", "data: ")), base64.b64encode(rng.randbytes(rng.randint(60, 160))).decode()),
        lambda: (rng.choice(("version ", "build ", "")), f"{word()}-{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-{word()}{rng.randint(0, 9)}"),
        lambda: (rng.choice(("license ", "password: ", "secret: ", "")), f"{word()}-{word()}-{word()}-{rng.randint(1, 9)}.{rng.randint(0, 9)}"),
    )
    out = []
    for i in range(n):
        if i % 16 in (1, 2):
            out.append((f"{prose(3)}\n", block() if i % 16 == 1 else sample(), "\n" + prose(3), i % 16 % 2))
        elif i % 8 == 3:
            ask = rng.choice(asks) + rng.choice((" = \"", "=", ": ", " = '", ": \"", "=\""))
            out.append((f"{prose(3)} {ask}", rng.choice(chosen)(), rng.choice(("\" ", "' ", " ", "\n")) + prose(3), 1))
        elif i % 8 == 4:
            ask = rng.choice((*asks, "access", "key", "auth", "private", "api")) + rng.choice((" = \"", "=", ": ", " = '", ": \"", " ", " ", " "))
            out.append((f"{prose(3)} {ask}", rng.choice(plain)(), rng.choice(("\" ", "' ", " ", "\n")) + prose(3), 0))
        elif i % 2:
            ask = rng.choice(asks) + rng.choice((" = \"", "=", ": ", " = '", ": \"", " "))
            out.append((f"{prose(3)} {ask}", rng.choice(good)(), rng.choice(("\" ", "' ", " ", "\n")) + prose(3), 1))
        else:
            lead, x = rng.choice(bad)()
            out.append((f"{prose(3)} {lead}", x, rng.choice(("\" ", " ", "\n", ", ")) + prose(3), 0))
    return out


def train(findings: list[tuple[str, str, str, int]], most: int = 20_000, trees: int = 30) -> Forest:
    """A forest from labelled findings, of which at most ``most`` are used."""
    used = findings[:most]
    x = np.array([describe(b, c, a) for b, c, a, _ in used], float)
    return fit(x, np.array([r[3] for r in used], float), trees=trees)


SCHEMA = "doc_id long, start long, end long, n_chars long, sha256 string, score double"


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """Secrets found in ``docs``: one row per finding with its character range and score.

    Needs ``doc_id`` and ``text``; other columns are ignored.  Returns ``doc_id, start, end, n_chars,
    sha256`` (of the secret; the secret itself is not repeated) and ``score``, at ``threshold`` or
    more.  Every text is read whole.  Null and empty texts have no findings; repeated rows and null
    ids give rows of their own; an empty table gives an empty result.
    """
    model = forest or train(labelled_findings())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows, x = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                value = text.as_py()
                for s, e, before, secret, after in candidates(value) if value else ():
                    rows.append((doc_id, s, e, e - s, hashlib.sha256(secret.encode()).hexdigest()))
                    x.append(describe(before, secret, after))
            score = model.predict(np.array(x, float)) if x else np.zeros(0)
            kept = [(*r, float(p)) for r, p in zip(rows, score) if p >= threshold]
            cols = list(zip(*kept)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "start", "end", "n_chars", "sha256", "score"])

    return docs.select("doc_id", "text").mapInArrow(find, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))
