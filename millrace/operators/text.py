"""Logs, secrets, text quality, HTML, dates and formats, as regular expressions in SQL."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..plans.dialect import Registry, on_tables
from .relational import ERROR_WORDS, LEVELS, C, ones

R = Registry()
op = R.op

# fixed values: what is masked in a message, in this order
MASKS = [
    (r"\b[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]+)?\b", "<IP>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"/[0-9]+\b", "/<ID>"),
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?\b", "<TIMESTAMP>"),
    (r"\b[0-9]{10,13}\b", "<EPOCH>"),
    (r"\b[0-9]+[.][0-9]+(?:ms|s|m)\b", "<DURATION>"),
    (r"\b[0-9]{4,}\b", "<NUM>"),
    (r'"/[^"]*"', '"<PATH>"'),
]


def masked(d, x: str) -> str:
    for pattern, by in MASKS:
        x = d.replace(x, pattern, by)
    return x


def strip(d, x: str) -> str:
    """All white space at the ends, not blanks alone."""
    return d.replace(x, r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")


@op("str_normalize_message", fx.logs)
def str_normalize_message(d, rel):
    return f"SELECT event_id, {masked(d, 'message')} AS message FROM {rel} t"


@op("log_cluster", fx.logs)
def log_cluster(d, rel):
    """Errors by masked text with a sample, a count and the first and last time."""
    levels = ", ".join(map(d.lit, LEVELS))
    q = f"SELECT event_id, stamp, message, {masked(d, 'message')} AS pattern FROM {rel} t WHERE upper(level) IN ({levels}) OR {d.like('message', ERROR_WORDS)}"
    return f"SELECT pattern, count(*) AS n, min_by(message, event_id) AS sample, min(stamp) AS first_seen, max(stamp) AS last_seen FROM ({q}) q GROUP BY pattern"


def log_lines(d) -> str:
    """The same events as JSON, syslog and access lines."""
    day = d.stamp("ts")
    js = "concat('{\"timestamp\":\"', " + day + ", '\",\"level\":\"', CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END, '\",\"message\":\"', event_type, '\"}')"
    sys = f"concat('Jan ', {d.extract(day, '-([0-9]{2}) ')}, ' ', {d.extract(day, ' (.*)$')}, ' host', CAST(user_id AS VARCHAR(20)), ' app[12]: ', event_type, ' happened')"
    ngx = f"concat('10.0.0.', CAST(user_id % 200 AS VARCHAR(20)), ' - - [', {day}, '] \"GET /', event_type, ' HTTP/1.1\" ', CASE WHEN event_type = 'error' THEN '503' ELSE '200' END, ' 12')"
    return f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {js} WHEN 1 THEN {sys} ELSE {ngx} END AS line FROM events"


@op("log_parse_json", log_lines)
def log_parse_json(d, rel):
    return f"SELECT event_id, {d.json('line', 'timestamp')} AS stamp, upper({d.json('line', 'level')}) AS level, {d.json('line', 'message')} AS message FROM (SELECT * FROM {rel} t WHERE line LIKE '{{{{%' OR line LIKE '{{%') j"


@op("log_parse_syslog", log_lines, year=2024)
def log_parse_syslog(d, rel, year):
    """The year is a parameter, as lines have none."""
    p = r"^([A-Z][a-z]{2}) +([0-9]{1,2}) ([0-9:]{8}) ([^ ]+) ([^:\[]+)(?:\[[0-9]+\])?: (.*)$"
    g = lambda i: d.extract("line", p, i)
    return f"SELECT event_id, concat('{year}-01-', {g(2)}, ' ', {g(3)}) AS stamp, {g(4)} AS host, {g(5)} AS app, {g(6)} AS message FROM (SELECT * FROM {rel} t WHERE {d.like('line', p)}) s"


@op("log_parse_nginx", log_lines)
def log_parse_nginx(d, rel):
    """The level follows the status."""
    p = r'^([^ ]+) [^ ]+ [^ ]+ \[([^\]]+)\] "([A-Z]+) ([^ ]+)[^"]*" ([0-9]{3}) '
    g = lambda i: d.extract("line", p, i)
    return f"SELECT event_id, {g(1)} AS client, {g(4)} AS path, CAST({g(5)} AS INT) AS status, CASE WHEN {g(5)} >= '500' THEN 'ERROR' WHEN {g(5)} >= '400' THEN 'WARN' ELSE 'INFO' END AS level FROM (SELECT * FROM {rel} t WHERE {d.like('line', p)}) n"


FORMATS = (("json", r"^\s*\{.*\}\s*$"), ("syslog", r"^[A-Z][a-z]{2} +[0-9]+ "), ("nginx", r'^[^ ]+ [^ ]+ [^ ]+ \[.*\] "'))


@op("log_detect_format", log_lines, line="line", order="event_id")
def log_detect_format(d, rel, line, order):
    """The first format that one of the first 20 lines has; JSON without any."""
    valid = f"try_parse_json({line}) IS NOT NULL" if d.spark else f"json_valid({line})"
    tests = " ".join(f"WHEN {d.like(line, p)}{' AND ' + valid if n == 'json' else ''} THEN '{n}'" for n, p in FORMATS)
    first = f"SELECT CASE {tests} END AS format, {order} AS place FROM {rel} t ORDER BY {order} LIMIT 20"
    return f"SELECT coalesce(min_by(format, place), 'json') AS format FROM ({first}) f WHERE format IS NOT NULL"


#: Strings of a task, of whose characters it sorts the counts.
STRINGS = 50_000


@op("str_shannon_entropy", lambda d: f"SELECT p_partkey AS id, p_name AS s FROM {d.dealt('part', 'p_partkey', STRINGS)}")
def str_shannon_entropy(d, rel):
    """Bits per character."""
    rel = d.dealt(rel, "id", STRINGS)
    chars = d.unnest("split(s, '')" if d.spark else "string_split(s, '')")
    c = f"SELECT id, ch, CAST(count(*) AS DOUBLE) AS k FROM (SELECT id, {chars} AS ch FROM {rel} t) x WHERE ch <> '' GROUP BY id, ch"
    return f"SELECT id, round(-sum(p * log2(p)), 6) + 0e0 AS entropy FROM (SELECT id, k / sum(k) OVER (PARTITION BY id) AS p FROM ({c}) c) q GROUP BY id"


# fixed values: published formats of credentials
SECRET_RULES = {
    "aws_access_key": r'AKIA[0-9A-Z]{16}',
    "aws_secret_access_key": r"""(?i)aws[_\-]?secret[_\-]?access[_\-]?key\s*[=:]\s*[\"']?[A-Za-z0-9/+=]{40}""",
    "aws_secret_key": r"""(?i)aws[_\-]?secret[_\-]?key\s*[=:]\s*[\"']?[A-Za-z0-9/+=]{20,}""",
    "github_token": r'ghp_[0-9a-zA-Z]{36}',
    "github_pat": r'github_pat_[0-9a-zA-Z_]{82}',
    "github_oauth": r'gho_[0-9a-zA-Z]{36}',
    "slack_bot": r'xoxb-[0-9]{10,13}-[0-9]{10,13}-[a-zA-Z0-9]{24}',
    "slack_user": r'xoxp-[0-9]{10,13}-[0-9]{10,13}-[0-9]{10,13}-[a-zA-Z0-9]{32}',
    "private_key": r'-----BEGIN\s(?:RSA\s|EC\s|DSA\s|OPENSSH\s)?PRIVATE\sKEY-----',
    "api_key": r"""(?i)(?:api[_\-]?key|apikey)\s*[=:]\s*[\"'][0-9a-zA-Z_\-]{20,}[\"']""",
    "generic_secret": r"""(?i)(?:secret|token|password|passwd|pwd|credential)\s*[=:]\s*[\"'][^\"']{8,}[\"']""",
    "url_credentials": r'(?i)https?://[^:\s]+:[^@\s]+@[^\s]+',
    "jwt": r'eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}',
    "sendgrid_key": r'SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}',
    "stripe_secret": r'sk_live_[0-9a-zA-Z]{24,}',
    "stripe_publishable": r'pk_live_[0-9a-zA-Z]{24,}',
    "heroku_key": r"""(?i)heroku[_\-]?api[_\-]?key\s*[=:]\s*[\"']?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}""",
}
# quoted values whose entropy counts
QUOTED = r"""(?i)(?:key|secret|token|password|passwd|pwd|credential|auth|api)\s*[=:]\s*["']([^"']{20,})["']"""
ENTROPY = 4.5
#: Every match of a rule or of QUOTED holds one of these.
SECRET_HINTS = "= : AKIA ghp_ gho_ github_pat_ xox _live_ eyJ SG. -----BEGIN"


def entropy(d, v: str) -> str:
    """Bits per code point of a string."""
    chars = d.distinct(d.each(d.seq("1", f"CAST(length({v}) AS INT)"), "i", f"substr({v}, i, 1)"))
    share = f"((length({v}) - length(replace({v}, c, ''))) * 1e0 / length({v}))"
    bits = d.each(chars, "c", f"-{share} * log2({share})")
    return f"aggregate({bits}, 0e0, (a, x) -> a + x)" if d.spark else f"list_sum({bits})"


def lines_of(d, rel: str) -> str:
    return f"SELECT doc_id, {d.unnest(d.split('text', chr(10)))} AS line FROM {rel} t"


@op("sec_secret_patterns", "documents")
def sec_secret_patterns(d, rel):
    """Lines that match a rule, and quoted values of high entropy; comment lines count only with a keyword."""
    keep = f"{d.may_hold('line', SECRET_HINTS)} AND (NOT {d.like('line', '^[ \\t]*(#|//)')} OR {d.like('line', '(?i)(password|secret|token|key)')})"
    rules = ", ".join(f"{ones(d.like('line', p))} AS {n}" for n, p in SECRET_RULES.items())
    high = d.size(d.only(d.extract_all("line", QUOTED, 1), "v", f"{entropy(d, 'v')} > {ENTROPY}e0"))
    rows = f"SELECT * FROM ({d.long('doc_id', 'm', [{'rule': f"'{n}'", 'n': n} for n in [*SECRET_RULES, 'high_entropy']])}) f WHERE n > 0"
    return f"WITH l AS ({lines_of(d, rel)}), m AS (SELECT doc_id, {rules}, {C(f'sum({high})')} AS high_entropy FROM l WHERE {keep} GROUP BY doc_id) {rows}"


# fixed values: risky calls, each with the languages it concerns and texts that excuse a line
OWASP = {
    "sql_fstring": (r"""(?i)(?:execute|query|raw)\s*\(\s*f[\"'][^\n]*(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE)""", "py", ()),
    "sql_format": (r"""(?i)(?:execute|query|raw)\s*\(\s*[\"'][^\n]*(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE)[^\n]*[\"']\.format\s*\(""", "py", ()),
    "sql_concat": (r"""(?i)(?:execute|query|raw)\s*\(\s*[\"'][^\n]*(?:SELECT|INSERT|UPDATE|DELETE)[^\n]*[\"']\s*\+""", "java,js,php,py,rb,ts", ()),
    "sql_percent": (r"""(?i)(?:execute|query|raw)\s*\(\s*[\"'][^\n]*(?:SELECT|INSERT|UPDATE|DELETE)[^\n]*%s""", "py", ()),
    "os_system": (r'(?i)os\.system\s*\(', "py", ()),
    "shell_true": (r'(?i)subprocess\.(?:call|run|Popen|check_output|check_call)\s*\([^\n]*shell\s*=\s*True', "py", ()),
    "eval": (r'(?i)(?:^|[^\p{L}\p{N}_])eval\s*\(', "js,jsx,php,py,rb,ts,tsx", ()),
    "exec": (r'(?i)(?:^|[^\p{L}\p{N}_])exec\s*\(', "php,py", ()),
    "child_process": (r'(?i)child_process\.exec\s*\(', "js,ts", ()),
    "new_function": (r'(?i)new\s+Function\s*\(', "js,jsx,ts,tsx", ()),
    "inner_html": (r'(?i)\.innerHTML\s*=', "html,js,jsx,ts,tsx", ()),
    "outer_html": (r'(?i)\.outerHTML\s*=', "html,js,jsx,ts,tsx", ()),
    "document_write": (r'(?i)document\.write(?:ln)?\s*\(', "html,js,ts", ()),
    "dangerous_html": (r'(?i)dangerouslySetInnerHTML', "js,jsx,ts,tsx", ()),
    "v_html": (r'(?i)v-html\s*=', "html,vue", ()),
    "md5": (r"""(?i)(?:hashlib\.md5|MD5\.(?:Create|new)|createHash\s*\(\s*[\"']md5[\"'])""", "cs,js,py,rb,ts", ()),
    "sha1": (r"""(?i)(?:hashlib\.sha1|SHA1\.(?:Create|new)|createHash\s*\(\s*[\"']sha1[\"'])""", "cs,js,py,rb,ts", ()),
    "weak_cipher": (r'(?i)(?:DES|RC4|ARC4|Blowfish)\.(?:new|encrypt|create)', "java,js,py,ts", ()),
    "path_traversal": (r'(?i)(?:open|readFile|readFileSync|createReadStream)\s*\([^\n]*\+[^\n]*(?:req\.|request\.|params|query|body)', "js,py,ts", ()),
    "debug_true": (r'(?i)(?:DEBUG\s*=\s*True|app\.debug\s*=\s*True|\"debug\"\s*:\s*true)', "js,json,py,ts,yaml,yml", ()),
    "cors_any": (r"""(?i)(?:Access-Control-Allow-Origin|cors[^\n]*origin)[\"']?\s*[=:,]\s*[\"']?\*""", "conf,java,js,py,ts,yaml,yml", ()),
    "bind_all": (r"""(?i)(?:host|bind|listen)\s*[=:(][^\n]*?[\"']?0\.0\.0\.0[\"']?""", "conf,js,py,ts,yaml,yml", ()),
    "pickle": (r'(?i)pickle\.(?:loads?|Unpickler)\s*\(', "py", ()),
    "yaml_load": (r'(?i)yaml\.load\s*\(', "py", ("SafeLoader", "safe_load", "CSafeLoader")),
    "marshal": (r'(?i)marshal\.loads?\s*\(', "py", ()),
    "unserialize": (r'(?i)(?:^|[^\p{L}\p{N}_])unserialize\s*\(', "php", ()),
    "ssrf": (r'(?i)(?:requests\.get|requests\.post|fetch|urllib\.request\.urlopen|http\.get)\s*\(\s*(?:req\.|request\.|params|query|body|user)', "js,py,ts", ()),
}


@op("sec_owasp_patterns", "pages", languages=("html", "any"))
def sec_owasp_patterns(d, rel, languages):
    """Lines that match a rule of the languages and hold no text that excuses them."""
    mine = {n: (p, x) for n, (p, langs, x) in OWASP.items() if set(langs.split(",")) & set(languages)}
    one = lambda p, x: " AND ".join([d.like("line", p), *(f"NOT contains(line, {d.lit(e)})" for e in x)])
    rules = ", ".join(f"{ones(one(p, x))} AS {n}" for n, (p, x) in mine.items())
    rows = f"SELECT * FROM ({d.long('page_id', 'm', [{'rule': f"'{n}'", 'n': n} for n in mine])}) f WHERE n > 0"
    return f"WITH l AS (SELECT page_id, {d.unnest(d.split('html', chr(10)))} AS line FROM {rel} t), m AS (SELECT page_id, {rules} FROM l GROUP BY page_id) {rows}"


CJK = r"[\x{4e00}-\x{9fff}]"


@op("text_count_cjk", fx.cjk)
def text_count_cjk(d, rel):
    return f"SELECT doc_id, {d.count_of('text', CJK)} AS cjk FROM {rel} t"


WORD = r"[A-Za-z][A-Za-z0-9'-]*"


@op("text_count_en", fx.cjk)
def text_count_en(d, rel):
    return f"SELECT doc_id, {d.count_of('text', WORD)} AS words FROM {rel} t"


@op("text_detect_lang", fx.cjk)
def text_detect_lang(d, rel):
    return f"SELECT doc_id, CASE WHEN {d.count_of('text', CJK)} > {d.count_of('text', WORD)} THEN 'zh' ELSE 'en' END AS lang FROM {rel} t"


@op("text_strip_markdown", lambda d: f"SELECT p_partkey AS id, concat('# Title ', p_name, {d.lit(chr(10))}, '- **bold** `code` [link](http://x.y/', CAST(p_size AS VARCHAR(20)), ') ~~no~~', {d.lit(chr(10))}, '> quote ![img](a.png)') AS text FROM part")
def text_strip_markdown(d, rel):
    x = "text"
    for p, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"[*][*]([^*]*)[*][*]", "$1"), (r"~~([^~]*)~~", "$1"), (r"(?m)^#+ *", ""), (r"(?m)^> *", ""), (r"(?m)^[-*] +", ""), (r"\n+", " ")):
        x = d.replace(x, p, by)
    return f"SELECT id, {x} AS text FROM {rel} t"


@op("text_density", fx.cjk)
def text_density(d, rel):
    """Dashes per 1000 ideographs, and Latin words between ideographs."""
    n = d.count_of("text", CJK)
    return f"SELECT doc_id, round({d.count_of('text', chr(0x2014))} * 1e3 / nullif({n}, 0), 4) AS dashes, {d.count_of('text', CJK + '[A-Za-z]{2,}' + CJK)} AS leaks FROM {rel} t"


# fixed values: patterns, matches that do not count (oracles have no look-around), and caps per 1000 ideographs
RATES = {
    "simile": ("像是|好像|仿佛|如同|宛如|宛若|犹如|好似|[想象映图]像是|[想象映图]像|像[素章片机样]|像", "^([想象映图]像|像[素章片机样])$", "3e0"),
    "dash": ("——", "", "2e0"),
    "tic": ("缓缓|微微|轻轻松|轻轻|淡淡|嘴角", "^轻轻松$", "5e0"),
    "not_but": (r"不是[^。！？\n]{1,18}而是|并非[^。！？\n]{1,18}而是|没有[^。！？\n]{1,18}只有", "", "1e0"),
}
# caps for a whole text
WORK_CAPS = {"hedging": (r"(也许是|或许是)[^。\n]{0,30}(也许|或许)", 2), "set_phrases": ("心潮澎湃|热血沸腾|百感交集|心乱如麻|思绪万千", 2)}
LEAKS = {"heading_leak": r"(?m)^\s*#{1,6}\s", "bold_leak": r"\*\*[^*\n]+\*\*", "backtick_leak": r"`[^`\n]+`", "citation_leak": r"oaicite|turn[0-9]+search|\[\^?[0-9]+\^?\]"}
IDEOGRAPH = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


# fixed values: what every match of a rate holds one of
NEEDED = {"simile": "像 仿佛 如同 宛如 宛若 犹如 好似", "dash": "——", "tic": "缓缓 微微 轻轻 淡淡 嘴角", "not_but": "不是 并非 没有"}


def wide(d, hits: str, literals: str = "") -> str:
    """What only texts with characters of more than one byte have, and with one of the literals if any are given: others are not searched in Spark."""
    may = "octet_length(text) > length(text)" + (f" AND {d.may_hold('text', literals)}" if literals else "")
    return f"CASE WHEN text IS NULL OR {may} THEN {hits} ELSE 0 END" if d.spark else hits


def rate_hits(d, rate: str) -> str:
    pattern, no, _ = RATES[rate]
    hits = d.size(d.only(d.extract_all("text", pattern), "v", f"NOT {d.like('v', no)}")) if no else d.count_of("text", pattern)
    return wide(d, hits, NEEDED[rate])


@op("text_rate_checks", fx.cjk)
def text_rate_checks(d, rel):
    """Phrases per 1000 ideographs above their caps, phrases above a cap per text, and leaks of markup, none of which may be there."""
    caps = WORK_CAPS | {k: (p, 0) for k, p in LEAKS.items()}
    hits = {k: rate_hits(d, k) for k in RATES} | {k: d.count_of("text", p) for k, (p, _) in caps.items()}
    counts = f"SELECT doc_id, {wide(d, d.count_of('text', IDEOGRAPH))} AS ideographs, {', '.join(f'{x} AS {k}' for k, x in hits.items())} FROM {rel} t"
    rows = [{"rule": f"'{k}'", "hits": k, "n": "ideographs", "cap": cap} for k, (_, _, cap) in RATES.items()]
    rows += [{"rule": f"'{k}'", "hits": k, "n": "CAST(NULL AS BIGINT)", "cap": f"{cap}e0"} for k, (_, cap) in caps.items()]
    return f"SELECT doc_id, rule, hits, CASE WHEN n IS NOT NULL THEN round(hits * 1e3 / greatest(n, 1), 4) END AS rate, CASE WHEN n IS NULL THEN hits ELSE hits * 1e3 / greatest(n, 1) END > cap AS over_cap FROM ({d.long('doc_id', f'({counts})', rows)}) r"


@op("text_rate_reference", fx.cjk, reference=fx.cjk)
def text_rate_reference(d, rel, reference):
    """Rates and kind of quotes against those of a reference text.

    A rate passes within half and one and a half times the reference's, or
    without a hit; curly or straight quotes lead in both, or there are none.
    """
    hits = ", ".join(f"{rate_hits(d, k)} AS {k}" for k in RATES)
    counts = lambda key, rel: f"(SELECT {key}{wide(d, d.count_of('text', IDEOGRAPH))} AS n, {hits}, {wide(d, d.count_of('text', '[\u201c\u201d]'))} AS curly, {d.count_of('text', chr(34))} AS straight FROM {rel} t)"
    rows = [{"rule": f"'{k}'", "a": k, "b": "n"} for k in RATES] + [{"rule": "'quotes'", "a": "curly", "b": "straight"}]
    ref = f"SELECT rule, sum(a) AS ra, sum(b) AS rb, sum(a) * 1e3 / greatest(sum(b), 1) AS rr FROM ({d.long('', counts('', reference), rows)}) s GROUP BY rule"
    near = "a = 0 OR a * 1e3 / greatest(b, 1) BETWEEN rr * 5e-1 AND greatest(rr * 15e-1, 5e-1)"
    passed = f"CASE WHEN q.rule = 'quotes' THEN a + b = 0 OR (a >= b) = (ra >= rb) ELSE {near} END"
    rate = lambda x: f"CASE WHEN q.rule <> 'quotes' THEN round({x}, 4) END"
    return f"SELECT doc_id, q.rule, a AS hits, {rate('a * 1e3 / greatest(b, 1)')} AS rate, {rate('rr')} AS reference_rate, {passed} AS passed FROM ({d.long('doc_id', counts('doc_id, ', rel), rows)}) q JOIN ({ref}) r ON q.rule = r.rule"


@op("text_chunk_overlap", "documents", tokens=250, overlap=0.1, chars_per_token=4)
def text_chunk_overlap(d, rel, tokens, overlap, chars_per_token):
    """Chunks of S characters every S less the overlap; the tail inside the overlap is a chunk too."""
    size = tokens * chars_per_token
    step = size - int(size * overlap)
    start = d.unnest(d.seq("CAST(0 AS BIGINT)", f"CAST(floor((length(text) - 1) / {step}e0) AS BIGINT)"))
    return f"SELECT doc_id, i AS chunk, i * {step} AS start, {C(f'length(substr(text, CAST(i * {step} + 1 AS INT), {size}))')} AS size, {d.sha256(f'substr(text, CAST(i * {step} + 1 AS INT), {size})')} AS digest FROM (SELECT doc_id, text, {start} AS i FROM {rel} t WHERE length(text) > 0) c"


def srt_text(srt: Column) -> Column:
    """Paragraphs of subtitles: no counters, times, tags and neighbouring repeats; a paragraph ends with a sentence or past 200 characters."""
    lines = F.filter(F.transform(F.split(srt, "\n"), F.trim), lambda x: ~x.rlike(r"^[0-9]+$|^[0-9]{2}:[0-9]{2}:[0-9]{2}") & (x != ""))
    clean = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), "align:.*$|position:.*$", ""))), lambda x: x != "")

    def fold(lines: Column) -> Column:
        once = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
        start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

        def step(s, x):
            now = F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(" "), x))
            full = (F.length(now) > 200) | x.rlike("[。！？.!?]$")
            return F.struct(F.when(full, "").otherwise(now).alias("now"), F.when(full, F.concat(s["done"], F.array(now))).otherwise(s["done"]).alias("done"))

        return F.aggregate(once, start, step, lambda s: F.array_join(F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))), "\n\n"))

    return F.element_at(F.transform(F.array(clean), fold), 1)


def srt_clean(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, srt_text(F.col(column)).alias("text"))


_SRT = r"""WITH RECURSIVE l AS (SELECT concat(conv_id, '-', turn) AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$|^[0-9]{2}:[0-9]{2}:[0-9]{2}')) AS a FROM conversations),
  o AS (SELECT id, list_filter(list_concat(a, a), lambda x, i: i = 1 OR x <> list_concat(a, a)[i - 1]) AS a FROM l),
  f AS (SELECT id, a, 1 AS i, '' AS now, '' AS done FROM o
    UNION ALL SELECT id, a, i + 1, CASE WHEN full_now THEN '' ELSE more END, CASE WHEN full_now THEN concat(done, CASE WHEN done = '' THEN '' ELSE chr(10) || chr(10) END, more) ELSE done END
      FROM (SELECT *, length(more) > 200 OR regexp_matches(a[i], '[。！？.!?]$') AS full_now FROM (SELECT *, CASE WHEN now = '' THEN a[i] ELSE concat(now, ' ', a[i]) END AS more FROM f WHERE i <= len(a)) m) n)
  SELECT id, concat(done, CASE WHEN now <> '' AND done <> '' THEN chr(10) || chr(10) ELSE '' END, now) AS text FROM f WHERE i > len(a)"""


@R.query("text_srt_clean", _SRT, on=srt_clean)
def text_srt_clean(spark, sf_dir):
    """Turns of conversations as subtitles with a repeated line."""
    df = on_tables(spark, sf_dir, r"SELECT concat(conv_id, '-', turn) AS id, concat(turn, '\n00:00:01,000 --> 00:00:02,000\n<i>', text, '</i>\n', text) AS srt FROM conversations")
    return srt_clean(df, "id", "srt")


@op("text_structure_check", "documents")
def text_structure_check(d, rel):
    return f"SELECT doc_id, {d.size(d.split('text', chr(10)))} AS line_count, {d.count_of('text', '(?m)^#{1,6} ')} AS headings, {d.count_of('text', '[.!?]')} AS sentences, {d.like('text', '(?i)(summary|conclusion)')} AS has_summary, {d.like('text', '[|].*[|]')} AS has_table FROM {rel} t"


DROPPED = ("script", "noscript", "style", "link", "svg", "img", "video", "iframe", "canvas")


def bare_html(d, x: str) -> str:
    for tag in DROPPED:
        x = d.replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "") if tag not in ("link", "img") else x
        x = d.replace(x, rf"(?is)<{tag}\b[^>]*/?>", "")
    return x


@op("html_strip_elements", "pages")
def html_strip_elements(d, rel):
    return f"SELECT page_id, {C("length(" + bare_html(d, "html") + ")")} AS size, {d.sha256(bare_html(d, 'html'))} AS digest FROM {rel} t"


PAGE = "title string, headings array<struct<level: int, text: string>>, nav_links array<struct<text: string, href: string>>, sections array<struct<tag: string, id: string, `class`: string, role: string>>, main_words long, description string, keywords string, canonical string, og_title string"
INLINE = {"a", "abbr", "b", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}
EMPTY_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def page_structure(html: str | None) -> tuple:
    """Title, headings, navigation links, sections, words of the main part and metadata of a page."""
    from html.parser import HTMLParser

    class Page(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.title, self.heads, self.links, self.sections, self.main, self.meta = [], "", [], [], [], None, {}

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "meta":
                self.meta.setdefault(a.get("name") or a.get("property"), a.get("content"))
            if tag == "link" and a.get("rel") == "canonical":
                self.meta.setdefault("canonical", a.get("href"))
            main = self.main is None and (tag == "main" or a.get("role") == "main" or a.get("id") in ("main", "content") or "main-content" in (a.get("class") or "").split())
            if main:
                self.main = ""
            if tag in EMPTY_TAGS:
                return
            self.apart(tag)
            self.path.append((tag, main, tag in ("nav", "header") or a.get("role") == "navigation"))
            if tag in ("main", "article", "section", "aside", "footer"):
                self.sections.append((tag, a.get("id") or None, (a.get("class") or "")[:100] or None, a.get("role")))
            if re.fullmatch("h[1-6]", tag):
                self.heads.append([int(tag[1]), ""])
            if tag == "a" and any(nav for _, _, nav in self.path):
                self.links.append(["", a.get("href") or ""])

        def apart(self, tag):
            if self.main is not None and tag not in INLINE:
                self.main += " "

        def handle_endtag(self, tag):
            self.apart(tag)
            if any(t == tag for t, _, _ in self.path):
                while self.path.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            tags = [t for t, _, _ in self.path]
            if tags[-1:] == ["title"]:
                self.title += data
            if {"script", "style", "noscript", "title"} & set(tags):
                return
            if self.heads and any(re.fullmatch("h[1-6]", t) for t in tags):
                self.heads[-1][1] += data
            if "a" in tags and self.links and any(nav for _, _, nav in self.path):
                self.links[-1][0] += data
            if any(main for _, main, _ in self.path):
                self.main += data

    p = Page()
    p.feed(html or "")
    p.close()
    links = {}
    for text, href in p.links:
        if href and text.strip() and len(links) < 30:
            links.setdefault(href, (text.strip()[:100], href))
    words = None if p.main is None else max(1, len(p.main.split()))
    return p.title.strip(), [(n, t.strip()[:200]) for n, t in p.heads[:50]], list(links.values()), p.sections[:20], words, *(p.meta.get(k) for k in ("description", "keywords", "canonical", "og:title"))


def structure(df: DataFrame, key: str, column: str) -> DataFrame:
    def parse(batches):
        for batch in batches:
            rows = [page_structure(x.as_py()) for x in batch.column(1)]
            cols = [pa.array(list(c), f) for c, f in zip(zip(*rows), kinds)] if rows else [pa.array([], f) for f in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    three, text = pa.struct([("level", pa.int32()), ("text", pa.string())]), pa.string()
    kinds = [text, pa.list_(three), pa.list_(pa.struct([("text", text), ("href", text)])), pa.list_(pa.struct([(c, text) for c in ("tag", "id", "class", "role")])), pa.int64(), *[text] * 4]
    names = ["_key", "title", "headings", "nav_links", "sections", "main_words", "description", "keywords", "canonical", "og_title"]
    rows = df.select(F.col(key).alias("_key"), column)
    return rows.mapInArrow(parse, f"_key {rows.schema[0].dataType.simpleString()}, {PAGE}").withColumnRenamed("_key", key)


@R.query("html_structure", on=structure)
def html_structure(spark, sf_dir):
    return structure(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


@op("html_paginate", "pages", page=1, size=1000)
def html_paginate(d, rel, page, size):
    return f"SELECT page_id, substr(html, {(page - 1) * size + 1}, {size}) AS part, CAST(ceil(length(html) / {size}e0) AS BIGINT) AS pages FROM {rel} t"


@op("url_extract_sitemap", lambda d: f"SELECT page_id, concat('User-agent: *', {d.lit(chr(10))}, 'Sitemap: ', url, {d.lit(chr(10))}, 'sitemap: ', url, {d.lit(chr(10))}) AS robots FROM pages")
def url_extract_sitemap(d, rel):
    found = d.distinct(d.extract_all("robots", r"(?im)^sitemap: *([^ \n]+)", 1))
    return f"SELECT page_id, {d.unnest(found)} AS sitemap FROM {rel} t"


def citations(d) -> str:
    return "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('Smith, J. (2019). ', p_name, '. Journal, 4(2), 1-9. https://doi.org/10.1000/x', CAST(p_size AS VARCHAR(20))) WHEN 1 THEN concat('[1] J. Smith, \"', p_name, ',\" J. Tests, vol. 3, no. 1, pp. 1-9, 2018.') WHEN 2 THEN concat('Smith, John. \"', p_name, '.\" Journal 3, no. 2 (2017): 1-9. doi:10.1000/y', CAST(p_size AS VARCHAR(20))) ELSE p_name END AS text FROM part"


@op("cite_detect_style", citations)
def cite_detect_style(d, rel):
    return f"SELECT id, CASE WHEN {d.like('text', '^\\[[0-9]+\\]')} THEN 'ieee' WHEN {d.like('text', '[(][0-9]{4}[)][.]')} THEN 'apa' WHEN {d.like('text', '[(][0-9]{4}[)]:')} THEN 'chicago' ELSE 'unknown' END AS style FROM {rel} t"


@op("cite_extract_doi", citations)
def cite_extract_doi(d, rel):
    return f"SELECT id, {d.extract('text', '(10[.][0-9]{4,9}/[A-Za-z0-9._;()/:-]+)')} AS doi FROM {rel} t"


@op("cite_check", citations)
def cite_check(d, rel):
    checks = [("no year", f"NOT {d.like('text', '[12][0-9]{3}')}"), ("no author", f"NOT {d.like('text', '[A-Z][a-z]+, [A-Z]|[A-Z][.] [A-Z][a-z]+')}"), ("no pages", f"NOT {d.like('text', '[0-9]+-[0-9]+')}")]
    return f"SELECT id, issue FROM ({d.long('id', rel, [{'issue': f"'{n}'", 'found': c} for n, c in checks])}) f WHERE found"


@op("date_parse_multi", lambda d: "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '2024-03-0' || CAST(1 + p_size % 9 AS VARCHAR(20)) WHEN 1 THEN '03/1' || CAST(p_size % 9 AS VARCHAR(20)) || '/2024' WHEN 2 THEN 'March 1' || CAST(p_size % 9 AS VARCHAR(20)) || ', 2024' WHEN 3 THEN '2024/03/0' || CAST(1 + p_size % 9 AS VARCHAR(20)) WHEN 4 THEN 'on 2024-03-99 at noon' ELSE 'soon' END AS s FROM part")
def date_parse_multi(d, rel):
    """Formats in order; the last resort takes what looks like a date, valid or not."""
    fmts = [("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("MMMM d, yyyy", "%B %d, %Y"), ("yyyy/MM/dd", "%Y/%m/%d")]
    one = lambda a, b: d.day(f"try_to_timestamp(s, '{a}')") if d.spark else d.day(f"try_strptime(s, '{b}')")
    return f"SELECT id, coalesce({', '.join(one(a, b) for a, b in fmts)}, nullif({d.extract('s', '([0-9]{4}-[0-9]{2}-[0-9]{2})')}, '')) AS date FROM {rel} t"


@op("time_parse_ampm", lambda d: "SELECT p_partkey AS id, concat('at ', CAST(1 + p_size % 12 AS VARCHAR(20)), CASE WHEN p_partkey % 2 = 0 THEN ':30' ELSE '' END, CASE p_partkey % 3 WHEN 0 THEN 'am' WHEN 1 THEN ' PM' ELSE '' END) AS s FROM part")
def time_parse_ampm(d, rel):
    p = r"(?i)([0-9]{1,2})(?::([0-9]{2}))? *(am|pm)"
    h, m, a = (d.extract("s", p, i) for i in (1, 2, 3))
    return f"SELECT id, CASE WHEN {h} = '' THEN NULL ELSE concat(lpad(CAST((CAST({h} AS INT) % 12) + CASE WHEN lower({a}) = 'pm' THEN 12 ELSE 0 END AS VARCHAR(20)), 2, '0'), ':', CASE WHEN {m} = '' THEN '00' ELSE {m} END) END AS clock FROM (SELECT * FROM {rel} t WHERE {d.like('s', p)}) x"


def duration(s: str) -> str:
    """Text of seconds."""
    h, m = f"CAST(floor({s} / 36e2) AS BIGINT)", f"CAST(floor(({s} % 3600) / 6e1) AS BIGINT)"
    return f"CASE WHEN {s} < 0 THEN 'N/A' WHEN {s} >= 3600 THEN concat(CAST({h} AS STRING), 'h', CAST({m} AS STRING), 'm') WHEN {s} >= 0 THEN concat(CAST({m} AS STRING), 'm') END"


@op("dur_format", lambda d: "SELECT p_partkey AS id, CAST(p_partkey * 37 - 500 AS BIGINT) AS seconds FROM part", key="id", seconds="seconds")
def dur_format(d, rel, key, seconds):
    """Seconds as XhYm or Ym; below zero there is no duration."""
    return f"SELECT {key}, {duration(seconds)} AS text FROM {rel} t"


@op("dur_hhmm", lambda d: "SELECT p_partkey AS id, concat(CAST(p_size % 24 AS STRING), ':', lpad(CAST(p_partkey % 60 AS STRING), 2, '0')) AS a, CASE WHEN p_partkey % 13 = 0 THEN 'noon' ELSE concat(lpad(CAST(p_partkey % 24 AS STRING), 2, '0'), ':30') END AS b FROM part", key="id", start="a", end="b")
def dur_hhmm(d, rel, key, start, end):
    """Time from one HH:MM to another, over midnight where needed; null where either is no clock time."""
    whole = r"^\s*([0-9]+)\s*:\s*([0-9]+)\s*$"
    minutes = lambda c: f"(try_cast({d.extract(c, whole, 1)} AS BIGINT) * 60 + try_cast({d.extract(c, whole, 2)} AS BIGINT))"
    gap = f"SELECT {key}, {minutes(end)} - {minutes(start)} AS m FROM {rel} t"
    return f"SELECT {key}, {duration('s')} AS text FROM (SELECT {key}, (CASE WHEN m < 0 THEN m + 1440 ELSE m END) * 60 AS s FROM ({gap}) g) h"


@op("fmt_number_compact", lambda d: "SELECT p_partkey AS id, p_retailprice * p_partkey AS n FROM part", key="id", number="n", whole=False)
def fmt_number_compact(d, rel, key, number, whole):
    """Millions as M with one decimal; thousands as K, or of whole numbers with their commas."""
    one = lambda k: f"CAST(round({number} / {k}, 1) AS STRING)"
    rest = f"WHEN {number} >= 1000 THEN {d.commas(number)} ELSE CAST({number} AS STRING)" if whole else f"WHEN {number} >= 1e3 THEN concat({one('1e3')}, 'K') ELSE {one('1e0')}"
    return f"SELECT {key}, CASE WHEN {number} >= 1e6 THEN concat({one('1e6')}, 'M') {rest} END AS text FROM {rel} t"


@op("fmt_bytes", lambda d: "SELECT p_partkey AS id, CAST(p_partkey AS DOUBLE) * p_partkey * p_size AS kb FROM part", key="id", kb="kb")
def fmt_bytes(d, rel, key, kb):
    """Kilobytes as B, KB, MB, GB or TB; the first two without decimals."""
    n = f"({kb} * 1024e0)"
    step = [f"WHEN {n} < {1024 ** (k + 1)}e0 THEN concat(" + (f"CAST(CAST(floor({n} / {1024**k}e0) AS BIGINT) AS STRING)" if k < 2 else f"CAST(round({n} / {1024**k}e0, 1) AS STRING)") + f", ' {u}')" for k, u in enumerate(("B", "KB", "MB", "GB"))]
    return f"SELECT {key}, CASE {' '.join(step)} ELSE concat(CAST(round({n} / {1024**4}e0, 1) AS STRING), ' TB') END AS text FROM {rel} t"


def flatten_keys(df: DataFrame, key: str, column: str) -> DataFrame:
    """Dotted paths of leaves in each JSON value; a list is a leaf, what is no JSON has none."""

    def leaves(x, path):
        if isinstance(x, dict) and x:
            for k, v in x.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif path:
            yield path

    def flat(text):
        try:
            return list(leaves(json.loads(text), "")) if text else []
        except ValueError:
            return []

    @F.pandas_udf("array<string>")
    def paths(texts: pd.Series) -> pd.Series:
        return texts.map(flat)

    return df.select(key, F.explode(paths(F.col(column).cast("string"))).alias("path"))


@R.query("json_flatten_keys", "SELECT event_id, unnest(json_keys(props)) AS path FROM events WHERE props IS NOT NULL", flatten_keys)
def json_flatten_keys(spark, sf_dir):
    return flatten_keys(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props")


@op("json_get_path", "events")
def json_get_path(d, rel):
    return f"SELECT event_id, coalesce({d.json('props', 'k')}, 'none') AS v FROM {rel} t"


def header_of(text: str | None) -> dict[str, str | list[str]]:
    """Keys of a header between two rows of dashes: ``key: value``, or a list of ``- item`` lines."""
    head = re.match(r"---\r?\n(.*?)\r?\n---(?:\r?\n|$)", text or "", re.S)
    out: dict[str, str | list[str]] = {}
    key = None
    bare = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    for line in re.split(r"\r?\n", head[1]) if head else ():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("- ") and key:
            out[key] = [*(out[key] if isinstance(out[key], list) else ()), bare(line[2:].strip())]
        elif ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            out[key] = bare(value) if value else []
    return out


def frontmatter(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each key of each header: k, and v or the list items."""

    @F.pandas_udf("array<struct<k: string, v: string, items: array<string>>>")
    def pairs(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"k": k, "v": None if isinstance(v, list) else v, "items": v if isinstance(v, list) else None} for k, v in header_of(t).items()])

    return df.select(key, F.explode(pairs(column)).alias("p")).select(key, "p.k", "p.v", "p.items")


@R.query(
    "frontmatter_parse",
    "SELECT doc_id, 'lang' AS k, lang AS v, NULL AS items FROM documents UNION ALL SELECT doc_id, 'source', source, NULL FROM documents UNION ALL SELECT doc_id, 'tags', NULL, 'a|b' FROM documents",
    frontmatter,
)
def frontmatter_parse(spark, sf_dir):
    df = on_tables(spark, sf_dir, r"SELECT doc_id, concat('---\nlang: ', lang, '\n# note\nsource: \"', source, '\"\ntags:\n  - a\n  - b\n---\n', text) AS text FROM documents")
    return frontmatter(df, "doc_id", "text").withColumn("items", F.array_join("items", "|"))


@op("unit_to_ms", lambda d: "SELECT p_partkey AS id, concat(CAST(p_size AS VARCHAR(20)), CASE p_partkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'ms' ELSE 's' END) AS s FROM part")
def unit_to_ms(d, rel):
    n, u = d.extract("s", "^([0-9.]+)"), d.extract("s", "([a-z]+)$")
    return f"SELECT id, CAST({n} AS DOUBLE) * CASE {u} WHEN 'us' THEN 1e-3 WHEN 's' THEN 1e3 ELSE 1e0 END AS ms FROM {rel} t"


def _number(d, pattern: str, column: str) -> str:
    return f"coalesce(try_cast({d.extract(column, pattern)} AS DOUBLE), 0)"


def _milliseconds(d, pattern: str, column: str) -> str:
    unit = f"CASE {d.extract(column, pattern, 2)} WHEN 'us' THEN 1e-3 WHEN 's' THEN 1e3 ELSE 1e0 END"
    return f"round({_number(d, pattern, column)} * {unit}, 6)"


def wrk_output(d) -> str:
    lines = ["concat('  Latency   ', CAST(p_size AS STRING), '.5us   1.2ms  9.0ms')", "'     50%    1.25ms'", "concat('     90%   ', CAST(p_size AS STRING), '.1ms')", "'     99%    1.2s'", "concat('  ', CAST(p_partkey * 3 AS STRING), ' requests in 10.0s, 2MB read')"]
    lines += ["CASE WHEN p_partkey % 2 = 0 THEN '  Socket errors: connect 1, read 2, write 0, timeout 4' ELSE '' END", "CASE WHEN p_partkey % 3 = 0 THEN concat('  Non-2xx or 3xx responses: ', CAST(p_size AS STRING)) ELSE '' END", "concat('Requests/sec:   ', CAST(p_size AS STRING), '.5')"]
    return f"SELECT p_partkey AS id, concat({', chr(10), '.join(lines)}) AS output FROM part"


@op("perf_parse_wrk", wrk_output, key="id", column="output")
def perf_parse_wrk(d, rel, key, column):
    """Rates, latencies in ms, requests and errors; zero for what the output lacks."""
    at = lambda p: _milliseconds(d, rf"(?m)^\s*{p}%\s+([0-9.]+)(us|ms|s)", column)
    socket = r"Socket errors:\s*connect\s+([0-9]+),\s*read\s+([0-9]+),\s*write\s+([0-9]+),\s*timeout\s+([0-9]+)"
    errors = " + ".join([*(f"coalesce(try_cast({d.extract(column, socket, i)} AS BIGINT), 0)" for i in range(1, 5)), f"coalesce(try_cast({d.extract(column, 'Non-2xx or 3xx responses:[ ]+([0-9]+)')} AS BIGINT), 0)"])
    return f"""SELECT {key}, {_number(d, 'Requests/sec:[ ]+([0-9.]+)', column)} AS rps, {_milliseconds(d, r'(?m)^[ ]*Latency[ ]+([0-9.]+)(us|ms|s)[ ]', column)} AS avg_latency_ms, {at(50)} AS p50_ms, {at(90)} AS p90_ms, {at(99)} AS p99_ms,
      coalesce(try_cast({d.extract(column, '([0-9]+)[ ]+requests in')} AS BIGINT), 0) AS total_requests, {errors} AS errors FROM {rel} t"""


def ab_output(d) -> str:
    lines = ["concat('Complete requests:      ', CAST(p_partkey AS STRING))", "concat('Failed requests:        ', CAST(p_size AS STRING))", "concat('Requests per second:    ', CAST(p_size AS STRING), '.25 [#/sec] (mean)')", "'Time per request:       12.5 [ms] (mean)'", "'  50%      4'", "'  90%      8'", "concat('  99%     ', CAST(p_size AS STRING))"]
    table = "CASE WHEN p_partkey % 2 = 0 THEN concat('Percentage served,Time in ms', chr(10), '50,3.5', chr(10), '92,', CAST(p_size AS STRING), '.5', chr(10), '100,20.25') END"
    return f"SELECT p_partkey AS id, concat({', chr(10), '.join(lines)}) AS output, {table} AS percentiles FROM part"


@op("perf_parse_ab", ab_output, key="id", column="output", table="percentiles")
def perf_parse_ab(d, rel, key, column, table):
    """As for wrk; where there is a table of percentiles its 50th and the first from 90 and from 99 count."""
    text = lambda p: _number(d, rf"(?m)^\s+{p}%\s+([0-9]+)", column)
    rows = f"SELECT {key}, {d.unnest(d.extract_all(table, '(?m)^[0-9.]+,[0-9.]+'))} AS x FROM {rel} u WHERE {table} IS NOT NULL"
    pairs = f"SELECT {key}, CAST({d.extract('x', '^([0-9.]+),')} AS DOUBLE) AS p, CAST({d.extract('x', ',([0-9.]+)$')} AS DOUBLE) AS ms FROM ({rows}) x"
    told = f"SELECT {key}, max(CASE WHEN p = 50 THEN ms END) AS t50, min_by(ms, CASE WHEN p >= 90 THEN p END) AS t90, min_by(ms, CASE WHEN p >= 99 THEN p END) AS t99 FROM ({pairs}) q GROUP BY {key}"
    count = lambda p: f"coalesce(try_cast({d.extract(column, p)} AS BIGINT), 0)"
    return f"""SELECT t.{key}, {_number(d, 'Requests per second:[ ]+([0-9.]+)', column)} AS rps, {_number(d, r'(?m)Time per request:[ ]+([0-9.]+)[ ]+[\[]ms[\]][ ]+[(]mean[)]$', column)} AS avg_latency_ms, coalesce(t50, {text(50)}) AS p50_ms, coalesce(t90, {text(90)}) AS p90_ms, coalesce(t99, {text(99)}) AS p99_ms,
      {count('Complete requests:[ ]+([0-9]+)')} AS total_requests, {count('Failed requests:[ ]+([0-9]+)')} AS errors FROM {rel} t LEFT JOIN ({told}) s ON t.{key} = s.{key}"""


PATHS = lambda d: "SELECT p_partkey AS id, p_brand AS change_set, concat(CASE p_size % 6 WHEN 0 THEN 'docs/' WHEN 1 THEN 'tests/' WHEN 2 THEN '.github/workflows/' WHEN 3 THEN 'src/core/' ELSE 'src/api/' END, 'f', CAST(p_partkey AS VARCHAR(20)), CASE p_partkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.yml' ELSE '.py' END) AS path FROM part"


@op("classify_path", PATHS)
def classify_path(d, rel):
    """The first rule whose pattern the path has."""
    rules = [("test", "(?i)(^|/)tests?/|_test[.]|[.]spec[.]"), ("docs", "(?i)[.](md|rst|txt)$|(^|/)docs?/"), ("ci", "(?i)[.]github/|[.]gitlab-ci|jenkins"), ("build", "(?i)(makefile|dockerfile|package[.]json|[.]toml$)"), ("chore", "(?i)[.](yml|yaml|json|cfg)$")]
    return f"SELECT id, CASE {' '.join(f'WHEN {d.like("path", p)} THEN {d.lit(n)}' for n, p in rules)} ELSE 'code' END AS kind FROM {rel} t"


@op("classify_scope", PATHS)
def classify_scope(d, rel):
    """The most common directory below src, if half of the files or more are in it."""
    part = d.extract("path", "^(?:src/)?([A-Za-z0-9_.]+)/")
    c = f"SELECT change_set, {part} AS scope, count(*) AS n FROM {rel} t GROUP BY change_set, {part}"
    return f"SELECT change_set, CASE WHEN n * 2 >= total THEN scope ELSE 'mixed' END AS scope FROM (SELECT change_set, scope, n, sum(n) OVER (PARTITION BY change_set) AS total, row_number() OVER (PARTITION BY change_set ORDER BY n DESC, scope) AS rn FROM ({c}) c) q WHERE rn = 1"


# fixed values: subject prefixes of answers to invitations
REPLIES = ("accepted:", "declined:", "tentative:", "re:", "updated invitation:", "canceled:")


@op("reply_prefix", lambda d: "SELECT event_id AS id, concat(CASE event_id % 5 WHEN 0 THEN 'Accepted: ' WHEN 1 THEN 'DECLINED: ' WHEN 2 THEN 'Re: ' ELSE '' END, event_type) AS subject FROM events")
def reply_prefix(d, rel):
    return f"SELECT id, ({' OR '.join(f'lower(subject) LIKE {d.lit(p + chr(37))}' for p in REPLIES)}) AS is_reply FROM {rel} t"


@op("lang_resolve", fx.cjk)
def lang_resolve(d, rel):
    return f"SELECT doc_id, CASE WHEN {d.like('text', CJK)} THEN 'zh' WHEN {d.like('text', '[A-Za-z]')} THEN 'en' ELSE 'unknown' END AS lang FROM {rel} t"


@op("sci_humidity_ratio", lambda d: "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS celsius, CAST(p_partkey % 101 AS DOUBLE) AS humidity FROM part", key="id", temperature="celsius", humidity="humidity", pressure=101325.0)
def sci_humidity_ratio(d, rel, key, temperature, humidity, pressure):
    """Magnus formula in hPa; temperature in degrees, relative humidity in percent, pressure in Pa."""
    e = f"(61094e-4 * exp(17625e-3 * {temperature} / ({temperature} + 24304e-2)) * {humidity} / 1e2)"
    return f"SELECT {key}, round(622e-3 * {e} / ({pressure / 100:e} - {e}), 8) AS w FROM {rel} t"


@op("graph_import_edges", lambda d: f"SELECT p_partkey AS id, concat('import os', {d.lit(chr(10))}, 'from pkg.m', CAST(p_size AS VARCHAR(20)), ' import x', {d.lit(chr(10))}, 'import a.b') AS source FROM part")
def graph_import_edges(d, rel):
    found = d.extract_all("source", r"(?m)^(?:from|import) +([A-Za-z0-9_.]+)", 1)
    return f"SELECT id, {d.unnest(d.distinct(found))} AS module FROM {rel} t"


