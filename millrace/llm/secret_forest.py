"""Secret scan: candidate rules, then a random forest that removes false positives.

The forest sees a candidate's length and character classes, its transitions
under a letter-pair model of ordinary text, how much of it dictionary words
cover, the path it was found in and the words around it.  It is trained in numpy
from labelled findings: a table of (candidate, before, after, path, label), by
default a generated one of known key formats, passwords and look-alikes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEAR = 48  # code points of context on each side
# fixed values: published key formats
RULES = [
    ("aws_access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+"),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"),
    ("stripe_key", r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+"),
    ("google_api_key", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}"),
    ("jwt", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    ("private_key", r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"
     # up to the END line, else the lines of base64 that follow
     r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----|(?:[ \t]*+\r?\n[A-Za-z0-9+/=]{16,}+)*+)"),
    ("assignment", r"(?i:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|auth[_-]?key|access[_-]?key|credential)[\"']?\s{0,4}[:=]\s{0,4}[\"']?(?P<value>[^\s\"',;]{6,}+)"),
    ("high_entropy", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_-])"),
]
CANDIDATE = re.compile("|".join(f"(?P<{n}>{p})" for n, p in RULES))
#: No rule matches a text without one of these.
QUICK = r"[0-9=:]|-----BEGIN"
WORDS = (
    "access account address admin answer api apple auth backup bank base block board book build button cache change check class client cloud code color common company config connect control "
    "core count create data date day default delete demo design device document domain down dummy email enable engine entry error event example fake field file find first folder font form "
    "format frame function game general group guest hash head hello help home host house icon image index info input insert item job key label language last layout level library light line link "
    "list load local lock login machine main manager map master media member memory menu message method model module monkey name network new node note number object online open option order "
    "output package page param parent party pass password path payment people phone photo placeholder plan player point port power present private process product profile program project public query read "
    "record region remote report request reset response result root route rule sample save school screen script search second secret section select send server service session set shared shop "
    "show simple site size source space start state static status store street string style summer system table target task team temp template test text theme time title token tool total train "
    "type unit update upload user value version video view visit water web welcome white window winter word work world write year your zone"
).split()
ASK = re.compile(r"(?i)token|secret|passw|pwd|api|auth|key|credential|bearer")
PLAIN = re.compile(r"(?i)commit|sha\d*|md5|checksum|digest|hash|uuid|guid|integrity|revision|example|sample|placeholder|etag|version|license|isbn|build")
TEST_PATH = re.compile(r"(?i)test|example|sample|mock|fixture|doc|readme|spec")
CONFIG_PATH = re.compile(r"(?i)\.(?:env|ini|cfg|conf|ya?ml|json|properties|toml|tf|sh|pem)$|config|secret|deploy")
N_FEATURES = 24


def _pair_model() -> np.ndarray:
    """log P(next | letter) over a-z and one class for the rest, from the dictionary."""
    n = np.full((27, 27), 0.5)
    for w in WORDS:
        at = [26, *(ord(c) - 97 for c in w), 26]
        for a, b in zip(at, at[1:]):
            n[a, b] += 1
    return np.log(n / n.sum(axis=1, keepdims=True))


_PAIRS = _pair_model()
_DICTIONARY = re.compile("|".join(sorted((w for w in WORDS if len(w) > 3), key=len, reverse=True)))


def features(value: str, before: str, after: str, path: str, rule: str) -> list[float]:
    n = max(1, len(value))
    low = value.lower()
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    counts = {c: low.count(c) for c in set(low)}
    full = {c: value.count(c) for c in set(value)}
    at = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
    pairs = sum(_PAIRS[a, b] for a, b in zip(at, at[1:])) / max(1, n - 1)
    cover = sum(len(m[0]) for m in _DICTIONARY.finditer(low)) / n
    run = best = 1
    for a, b in zip(value, value[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:])) / n
    names = [r for r, _ in RULES]
    return [
        n, sum(k == 0 for k in kind) / n, sum(k == 1 for k in kind) / n, sum(k == 2 for k in kind) / n, sum(k == 3 for k in kind) / n,
        -sum(v / n * math.log2(v / n) for v in full.values()), len(counts) / n, sum(a != b for a, b in zip(kind, kind[1:])) / n,
        pairs, cover, best / n, steps, float(all(c in "0123456789abcdef" for c in low)), float(n in (32, 40, 64) and all(c in "0123456789abcdef" for c in low)), float(low.count("-") == 4 and n == 36),
        float(bool(ASK.search(before))), float(bool(PLAIN.search(before))), float(bool(PLAIN.search(after))), float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(bool(re.search(r"(?i)your|xxx|example|change|<|\{|\$|\*\*|\.\.\.|placeholder|dummy|test", value))),
        float(bool(TEST_PATH.search(path))), float(bool(CONFIG_PATH.search(path))), names.index(rule), float(rule not in ("assignment", "high_entropy")),
    ]


def candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, rule, value) of each candidate, in code points, leftmost first."""
    for m in CANDIDATE.finditer(text):
        rule = m.lastgroup if m.lastgroup != "value" else "assignment"
        s, e = m.span("value") if rule == "assignment" else m.span()
        yield s, e, rule, text[s:e]


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, str, str, str, str, int]]:
    """Generated findings (value, before, after, path, rule, label)."""
    rng, more = np.random.default_rng(seed), np.random.default_rng(seed + 1)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum, hexa = upper + lower + digit, digit + "abcdef"
    word = lambda: str(rng.choice(WORDS))
    words = lambda k: " ".join(word() for _ in range(k))
    ask = lambda: str(rng.choice(["token", "secret", "password", "api_key", "auth_key", "access_key", "pwd"])) + str(rng.choice(["=", " = ", ": ", '="', ' = "', '": "']))
    paths = ["src0", "src7", "", "config/prod.yaml", ".env", "app/main.py", "deploy/secrets.json", "notes.txt"]
    # whole private keys and long values, drawn apart so that the other findings stay as they are
    body = lambda k: "".join(more.choice(list(alnum + "+/"), k))
    block = lambda head: head + "\n" + "".join(body(64) + "\n" for _ in range(int(more.integers(2, 27)))) + head.replace("BEGIN", "END")
    out = []
    for i in range(n):
        tail, path = " " + words(4), str(rng.choice(paths))
        if i % 2 == 0:
            kind = rng.integers(7)
            if kind == 0:
                out.append(("AKIA" + pick(upper + digit, 16), words(3) + " ", tail, path, "aws_access_key", 1))
            elif kind == 1:
                rule, value = [("github_token", "ghp_" + pick(alnum, 36)), ("slack_token", "xoxb-" + pick(digit, 11) + "-" + pick(alnum, 24)), ("stripe_key", "sk_live_" + pick(alnum, 24)), ("google_api_key", "AIza" + pick(alnum + "_-", 35))][rng.integers(4)]
                out.append((value, words(3) + str(rng.choice([" ", " " + ask()])), tail, path, rule, 1))
            elif kind == 2:
                out.append((pick(hexa, int(rng.choice([16, 17, 24, 32, 40, 64]))), words(3) + " " + ask(), tail, path, "assignment", 1))
            elif kind == 3:
                out.append((pick(alnum + "!@#%^&+/_-", int(rng.integers(8, 48))), words(3) + " " + ask(), tail, path, "assignment", 1))
            elif kind == 4:
                out.append((pick(alnum, int(rng.integers(28, 64))), words(2) + " " + str(rng.choice(["bearer ", "api key ", "auth "])), tail, path, "high_entropy", 1))
                if more.random() < 0.25:
                    out[-1] = (body(int(more.integers(64, 3000))), words(2) + " " + str(more.choice(["client-key-data: ", "bearer ", "auth "])), *out[-1][2:])
            elif kind == 5:
                out.append(("eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum, 43), "authorization: bearer ", tail, path, "jwt", 1))
            else:
                out.append((str(rng.choice(["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"])), words(2) + " ", tail, path, "private_key", 1))
                if more.random() < 0.75:
                    out[-1] = (block(out[-1][0]), *out[-1][1:])
            continue
        kind = rng.integers(8)
        plain = str(rng.choice(["commit ", "sha1 ", "checksum: ", "digest=", "etag ", "revision ", "md5: ", "build "]))
        if kind == 0:
            out.append((pick(hexa, int(rng.choice([32, 40, 64]))), words(2) + " " + plain, tail, path, "high_entropy", 0))
        elif kind == 1:
            h = pick(hexa, 32)
            out.append(("-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), words(2) + str(rng.choice([" uuid ", " id ", " "])), tail, path, "high_entropy", 0))
        elif kind == 2:
            out.append((str(rng.choice(["changeme", "your_token_here", "xxxxxxxxxxxx", "<password>", "${API_KEY}", "{{secret}}", "********", "placeholder1", "example123", "dummy-token", "test1234", "password1", "config.password", "os.environ"])), words(2) + " " + ask(), tail, path, "assignment", 0))
        elif kind == 3:
            out.append(("_".join(word() for _ in range(4)) + pick(digit, 2), words(3) + " ", tail, path, "high_entropy", 0))
        elif kind == 4:
            out.append((word() + word(), words(2) + " " + ask(), tail, path, "assignment", 0))
        elif kind == 5:
            out.append(("AKIA" + str(rng.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "0000000000000000", "EXAMPLEEXAMPLE12"])), words(2) + " ", tail, str(rng.choice(["docs/readme.md", "tests/test_key.py", ""])), "aws_access_key", 0))
        elif kind == 6:
            out.append((pick(digit, int(rng.integers(24, 40))), words(3) + " ", tail, path, "high_entropy", 0))
        else:
            out.append(("/".join(word() for _ in range(5)) + pick(digit, 1), words(3) + " ", tail, path, "high_entropy", 0))
    return out


class Forest:
    """Random forest of binary Gini trees, kept as flat arrays."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 5):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.nodes = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            tree: list[list[float]] = []  # feature, limit, left, right, share

            def grow(at: np.ndarray, depth: int) -> int:
                me = len(tree)
                share = float(y[at].mean())
                tree.append([-1, 0.0, -1, -1, share])
                if depth >= self.depth or share in (0.0, 1.0) or len(at) < 2 * self.least:
                    return me
                best = (1e9, -1, 0.0)
                for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                    order = np.argsort(x[at, f], kind="stable")
                    v, t = x[at[order], f], y[at[order]]
                    cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                    cut = cut[(cut >= self.least) & (cut <= len(at) - self.least)]
                    if not len(cut):
                        continue
                    ones = np.cumsum(t)[cut - 1]
                    p, q = ones / cut, (t.sum() - ones) / (len(at) - cut)
                    cost = cut * p * (1 - p) + (len(at) - cut) * q * (1 - q)
                    k = int(np.argmin(cost))
                    if cost[k] < best[0]:
                        best = (float(cost[k]), int(f), float((v[cut[k]] + v[cut[k] - 1]) / 2))
                if best[1] < 0:
                    return me
                go = x[at, best[1]] <= best[2]
                tree[me][:2] = [best[1], best[2]]
                tree[me][2] = grow(at[go], depth + 1)
                tree[me][3] = grow(at[~go], depth + 1)
                return me

            grow(rows, 0)
            self.nodes.append(np.array(tree))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go, t[at, 2], t[at, 3]).astype(np.int64), at)
            out += t[at, 4]
        return out / len(self.nodes)


def train(findings: list[tuple[str, str, str, str, str, int]] | None = None) -> Forest:
    """Fit the forest; ``findings`` is a bounded list of labelled findings."""
    rows = labelled_findings() if findings is None else findings
    return Forest().fit(np.array([features(*r[:5]) for r in rows]), np.array([r[5] for r in rows], float))


SCHEMA = "doc_id long, start long, end long, rule string, score double, predicted int"


def _scan_batches(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = [], []
            for doc, text, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                for s, e, rule, value in candidates(text):
                    rows.append((doc, s, e, rule))
                    x.append(features(value, text[max(0, s - NEAR) : s], text[e : e + NEAR], path or "", rule))
            score = forest.value.score(np.array(x)) if x else np.zeros(0)
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(list(c), k) for c, k in zip(cols, kinds)] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def scan(docs: DataFrame, path: str | None = "source", findings: list | None = None) -> DataFrame:
    """All candidates of whole texts with the forest's verdict.

    Returns doc_id, start and end (code points), rule, score and predicted (1: a
    secret).  ``path`` names a column with the path or source, or is None.  Null
    and empty texts have no candidates; null ids and paths are allowed; repeated
    rows give repeated findings; an empty table gives an empty result.
    """
    forest = docs.sparkSession.sparkContext.broadcast(train(findings))
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.where(F.col("text").rlike(QUICK)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", where.alias("path"))
    return rows.mapInArrow(_scan_batches(forest), SCHEMA)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_secrets": op3_secrets}
SQL: dict[str, str] = {}
