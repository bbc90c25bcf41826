"""Credentials in source code: where they are, and the content without them (problem 1).

Method: a trigram index over the chunks.  What each detection expression requires is derived from the expression
itself; posting lists are intersected and united; expressions are verified on candidate chunks only.  Indexes are built
for bounded blocks inside each task, so nothing is shuffled and no posting list outgrows a block.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.blocks import blocks
from codeloom.functions.trigrams import TrigramIndex, required, trigrams

REPLACEMENT = "REDACTED"

# fixed values: what names of credentials end with
_PASSWORD_NAME = r"(?:password|passwd|passphrase|passwort|pwd)"
_SECRET_NAME = r"(?:secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|signing[_-]?key|private[_-]?key|encryption[_-]?key|auth[_-]?key|account[_-]?key|master[_-]?key|webhook[_-]?key|license[_-]?key|credentials?|[_-]auth|svcauth|auth)"
_ASSIGN = r"[\"'\])]{0,3}\s*(?::\s*[A-Za-z_][\w.\[\]| ]*?\s*)?(?:=(?!=)|:|=>|:=)\s*"
_FALLBACK = r"(?:(?:os\.environ\.get|os\.getenv|environ\.get|getenv|config\.get|env\.get|env)\(\s*[\"'][^\"'\n]*[\"']\s*,\s*(?:default\s*=\s*)?|(?:process\.env[.\w\[\]\"']*|import\.meta\.env[.\w]*|[\w.]+)\s*(?:\|\||\?\?|\bor\b)\s*)?"
_OPEN = r"(?:\(\s*)?(?:[brfu]{0,2})(?P<q>\"\"\"|'''|[\"'`])"

#: name of the detector, expression (the group "v" is the value, or begins at it), how the value is judged
DETECTORS: list[tuple[str, re.Pattern[str], str]] = [
    ("private_key", re.compile(r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"), "key"),
    ("aws_key", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16})(?![A-Za-z0-9])"), "token"),
    ("github_token", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,})"), "token"),
    ("gitlab_token", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:glpat-|gldt-|glrt-|glptt-)[A-Za-z0-9_-]{18,})"), "token"),
    ("slack_token", re.compile(r"(?<![A-Za-z0-9])(?P<v>xox[abeoprs]-[A-Za-z0-9-]{12,})"), "token"),
    ("payment_key", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:sk_live_|sk_test_|rk_live_|rk_test_)[A-Za-z0-9]{14,})"), "token"),
    ("google_key", re.compile(r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_-]{30,})"), "token"),
    ("jwt", re.compile(r"(?<![A-Za-z0-9])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"), "token"),
    ("other_token", re.compile(r"(?<![A-Za-z0-9])(?P<v>npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}|dop_v1_[a-f0-9]{40,}|shpat_[a-fA-F0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|whsec_[A-Za-z0-9+/=]{24,})"), "token"),
    ("url_password", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/?#\"'`@]{1,80}:(?P<v>[^\s/\"'`@]{3,120})@[\w\[.-]", re.I), "password"),
    ("dsn_password", re.compile(r"(?:;|\?|&|\b|(?<=[\"'`]))(?:pwd|password)=(?P<v>[^;\"'`\s]{3,120})(?=;|[\"'`])", re.I), "password"),
    ("auth_header", re.compile(r"authorization[\"']?\s*[:=,]\s*[\"'`]?(?:bearer|basic|token|apikey)\s+(?P<v>[A-Za-z0-9._~+/=-]{8,})", re.I), "header"),
    ("key_header", re.compile(r"(?:x-api-key|x-auth-token|x-access-token|api-key|private-token)[\"']?\s*[:=,]\s*[\"'`]?(?P<v>[^\s\"'`,]{8,})", re.I), "secret"),
    ("password", re.compile(_PASSWORD_NAME + _ASSIGN + _FALLBACK + _OPEN + r"(?P<v>)", re.I), "password_string"),
    ("short_password", re.compile(r"(?<![A-Za-z])pass" + _ASSIGN + _FALLBACK + _OPEN + r"(?P<v>)", re.I), "password_string"),
    ("secret", re.compile(_SECRET_NAME + _ASSIGN + _FALLBACK + _OPEN + r"(?P<v>)", re.I), "secret_string"),
    ("comment", re.compile(r"(?:#|(?<!:)//|/\*|<!--|^\s*\*)[^\n]*?\b(?:password|passwd|pass|pwd|secret|token|key|credentials?|login|auth)\b[^\n:=\"'`]{0,30}[:=]\s*[\"'`]?(?P<v>[^\s\"'`,;]{6,})", re.I | re.M), "comment"),
    ("comment_pw", re.compile(r"(?:#|(?<!:)//)[^\n]*?\bpw:\s*(?P<v>[^\s\"'`,;]{6,})", re.I), "comment"),
]
_QUERIES = [required(p) for _, p, _ in DETECTORS]
_VOCABULARY = frozenset(t for q in _QUERIES for t in trigrams(q))

# fixed values: what stands where a value is left out
_PLACEHOLDER = re.compile(
    r"\*{3,}|x{4,}|•{2,}|\.{3}|…|^<.*>$|^\$[A-Z_({]|\$\{|\{\{|^\{.*\}$|^%\w+%$|^%[sdr]$|%\(\w+\)|^\[.*\]$|\byour\b|your[-_]|change[_-]?me|\bexample[-_]|placeholder|\bdummy\b|redacted|^todo|^(?:insert|replace|enter|put|add|set)[_-](?:.*[_-])?(?:here|me|this|it|value|key|token|secret|password)$|^(?:fake|sample|example|test|demo|default)(?:[_-]?(?:value|key|token|secret|password|pass|pwd|me))*$|^none$|^null$|^undefined$|^true$|^false$|^(?:my|the|a)?[_-]?(?:password|passwd|pwd|secret|token|key|credentials?|api[_-]?key)s?$"
    r"|^process\.env|^os\.|^env[:.(]|^vault[:/]|^ssm:|^arn:|^file:|^secret(?:s|smanager)?[:/]|^https?://(?![^/]*:[^/]*@)|^(.)\1+$|^test$|^empty$|^string$|^abc+$|^1234|^hidden$|^masked$",
    re.I,
)
_NOT_SECRET = re.compile(r"^(?:data:|sha\d{1,3}-|ssh-(?:rsa|ed25519) |-----BEGIN (?:PUBLIC|CERTIFICATE))", re.I)


def _usable(value: str, judge: str) -> bool:
    """Whether a value can be a usable credential."""
    if _PLACEHOLDER.search(value) or _NOT_SECRET.match(value) or len(set(value)) < 4:
        return False
    digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    symbol = any(not c.isalnum() and c not in "_" for c in value)
    mixed = value.lower() != value and value.upper() != value
    if judge == "token":
        return True
    if any(c.isspace() for c in value) or re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", value):
        return False
    if judge == "password":
        return len(value) >= 4 and (digit or symbol and mixed or symbol and len(value) >= 8 and not re.fullmatch(r"[\w.-]+", value)) and not re.fullmatch(r"\w+\(.*\)|[\w.]+\.\w+\(?", value)
    if judge == "comment":
        return digit and letter and len(value) >= 6 and not value.endswith((".py", ".js", ".ts", ")", "."))
    if len(value) < 8 or not letter:
        return False
    if re.fullmatch(r"[a-z]+(?:[._/-][a-z]+)+|[a-z_]+|[A-Za-z]+", value) and len(value) < 28:
        return False
    return digit or (mixed or symbol) and len(value) >= 16


def _literal(text: str, m: re.Match[str]) -> tuple[str, int, int]:
    """The string literal that opens at a match, put together with literals that continue it: value, start, end of the last piece."""
    quote, at = m["q"], m.end("q")
    value, start, end = "", at, at
    while True:
        stop = at
        while stop < len(text) and not text.startswith(quote, stop):
            if text[stop] == "\n" and len(quote) == 1 and quote != "`":
                return value, start, end  # no literal after all
            stop += 2 if text[stop] == "\\" else 1
        if stop >= len(text):
            return value, start, end
        value += text[at:stop]
        end = stop
        more = re.compile(r"(?:\s*\+\s*|\s*\\?\n\s*|[ \t]+)(?P<q>[\"'`])").match(text, stop + len(quote))
        if more is None or len(quote) == 3:
            return value, start, end
        quote, at = more["q"], more.end("q")


def credentials_in(text: str, detectors: list[int] | None = None) -> list[tuple[int, int, int, str]]:
    """(line, start, end, detector) of every usable credential, in order; those that overlap are one."""
    found: list[tuple[int, int, str]] = []
    for d in range(len(DETECTORS)) if detectors is None else detectors:
        name, pattern, judge = DETECTORS[d]
        for m in pattern.finditer(text):
            start, end = m.span("v")
            if judge == "key":
                close = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----").search(text, end)
                body = text[end : close.start() if close else len(text)]
                if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) < 24 or re.search(r"\.{3}|…|\*{3}|x{8}|<[^>\n]*>", body):
                    continue  # a mention of the marker, or a shortened key
                found.append((start, close.end() if close else len(text.rstrip()), name))
                continue
            if judge in ("password_string", "secret_string"):
                value, start, end = _literal(text, m)
                if value.startswith("-----BEGIN"):
                    continue
                if judge == "secret_string" and (basic := re.match(r"(?:bearer|basic|token)\s+", value, re.I)):
                    start += basic.end()
                    value = value[basic.end() :]
                if not _usable(value, judge.split("_")[0]):
                    continue
            else:
                value = m["v"]
                if judge == "header":
                    if re.search(r"basic\s+$", text[m.start() : start], re.I):
                        try:
                            user, colon, word = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode().partition(":")
                        except (binascii.Error, UnicodeDecodeError):
                            continue
                        if not colon or not word or _PLACEHOLDER.search(word):
                            continue
                    elif not _usable(value, "secret"):
                        continue
                elif not _usable(value, judge):
                    continue
            found.append((start, end, name))
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, int, str]] = []
    for start, end, name in found:
        if out and start < out[-1][2]:
            if end > out[-1][2] and name != "comment":
                out[-1] = (out[-1][0], out[-1][1], end, out[-1][3])
            continue
        out.append((text.count("\n", 0, start) + 1, start, end, name))
    return out


def redacted(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with only the values replaced; quotes and everything around them stay."""
    for _, start, end, _ in reversed(spans):
        inner = text[start:end]
        # a value put together over several literals keeps its quotes and line breaks
        pieces = re.split(r"([\"'`]\s*\+?\s*\\?\n?\s*[\"'`])", inner) if "\n" in inner and "-----" not in inner else [inner]
        text = text[:start] + "".join(p if i % 2 else REPLACEMENT if not i else "" for i, p in enumerate(pieces)) + text[end:]
    return text


def _scan(block: pa.RecordBatch) -> Iterator[tuple[int, str, list[tuple[int, int, int, str]]]]:
    """Row number, text and credentials of the rows that have any."""
    index = TrigramIndex(block.column("content"), _VOCABULARY)
    wanted: dict[int, list[int]] = {}
    for d, query in enumerate(_QUERIES):
        for r in index.candidates(query).tolist():
            wanted.setdefault(r, []).append(d)
    rows = np.array(sorted(wanted), np.int64)
    for r, text in zip(rows.tolist(), block.column("content").take(pa.array(rows)).to_pylist()):
        if text and (spans := credentials_in(text, wanted[r])):
            yield r, text, spans


def credential_spans(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, line_no, start_char, end_char, detector) of every usable credential, each once, several on a line too.

    Input: the key and content.  Null and empty contents hold none; rows without a key are left out; a row delivered twice counts
    once.  Lines are counted from 1 and split at newlines; offsets are in characters, end exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "content"):
            found = [(r, *s) for r, _, spans in _scan(block) for s in spans]
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [block.column(key).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.string())],
                [key, "line_no", "start_char", "end_char", "detector"],
            )

    kept = rows.select(key, "content").where(F.col(key).isNotNull() & (F.length("content") >= 8))
    return kept.mapInArrow(run, f"{key} bigint, line_no int, start_char int, end_char int, detector string").dropDuplicates([key, "start_char"])


def redacted_rows(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, content, credentials) of every row that held credentials, its values replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "content"):
            found = [(r, redacted(text, spans), len(spans)) for r, text, spans in _scan(block)]
            columns = list(zip(*found)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([block.column(key).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], [key, "content", "credentials"])

    kept = rows.select(key, "content").where(F.col(key).isNotNull() & (F.length("content") >= 8))
    return kept.mapInArrow(run, f"{key} bigint, content string, credentials int").dropDuplicates([key])
