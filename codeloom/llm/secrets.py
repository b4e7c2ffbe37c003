"""Secret scans: an Aho-Corasick prefilter, regular expressions anchored near its hits, checksum validation.

One automaton of all rules' keywords runs over the lower-case text.  Only at a hit, and only for the rules
that own the keyword, a regular expression is tried, anchored at the hit.  No expression bounds the length of
a secret.  A rule that takes a run of characters is tried once in each run, at its first hit, so repeated
keywords don't make a long run quadratic.
Tokens that carry a checksum, or a structure that can be checked, are reported as valid or dropped; the
others must have enough entropy.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tune

RESULT = "doc_id long, rule string, begin int, end int, length int, checked boolean, fingerprint string"
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(secret: str) -> bool:
    """The last 6 characters are the CRC-32 of the random part in base 62."""
    body, mark = secret.rsplit("_", 1)[-1][:-6], secret[-6:]
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = _BASE62[r] + digits
    return digits.rjust(6, "0") == mark


def aws_account(secret: str) -> bool:
    """Behind the prefix stands base 32; ids of the newer kind hold an account number of 12 digits."""
    try:
        raw = base64.b32decode(secret[4:])
    except (binascii.Error, ValueError):
        return False
    return (int.from_bytes(raw[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12


def jwt(secret: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(secret.split(".")[0] + "=="))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def pem(secret: str) -> bool:
    """The body is base 64 of a DER sequence, or of the other common container."""
    body = re.sub(r"-----[^-]+-----|[A-Za-z-]+: [^\n]*\n|\s", "", secret)
    try:
        raw = base64.b64decode(body, validate=True)
    except (ValueError, binascii.Error):
        return False
    return raw[:1] == b"\x30" or raw.startswith(b"openssh-key")


def luhn(secret: str) -> bool:
    digits = [int(c) for c in secret if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(secret: str) -> bool:
    s = secret.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


@dataclass(frozen=True)
class Rule:
    """A match's group "secret" is the secret. With check its result decides; strict rules drop what fails.

    run is a character class: hits in a run of it behind a hit that was tried are not tried.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[str], bool] | None = None
    strict: bool = True
    min_entropy: float = 0.0
    run: str = ""


RULES = (
    Rule("aws-access-key", ("akia", "asia", "abia", "acca"), r"(?<![A-Za-z0-9])(?P<secret>(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16})(?![A-Za-z0-9])", aws_account, strict=False, min_entropy=2.5),
    Rule("github-token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9])(?P<secret>gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", crc_base62),
    Rule("npm-token", ("npm_",), r"(?<![A-Za-z0-9])(?P<secret>npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])", crc_base62),
    Rule("slack-token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(?<![A-Za-z0-9])(?P<secret>xox[bpars]-[A-Za-z0-9-]{20,}+)", min_entropy=2.5, run="[A-Za-z0-9-]"),
    Rule("stripe-key", ("sk_live_", "rk_live_", "sk_test_"), r"(?<![A-Za-z0-9])(?P<secret>[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])", min_entropy=2.5),
    Rule("google-api-key", ("aiza",), r"(?<![A-Za-z0-9])(?P<secret>AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", min_entropy=3.0),
    Rule("json-web-token", ("eyj",), r"(?<![A-Za-z0-9])(?P<secret>eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{4,}+)(?![A-Za-z0-9_-])", jwt, run="[A-Za-z0-9_-]"),
    Rule("private-key", ("-----begin",), r"(?P<secret>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?!-----)[A-Za-z0-9+/=\s:,-]){40,}+-----END (?:[A-Z]+ )*PRIVATE KEY-----)", pem, strict=False),
    Rule("iban", ("iban",), r"(?i:iban)[\s:=\"']{1,4}(?P<secret>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", mod97),
    Rule("card-number", ("card", "visa", "mastercard"), r"(?i:card(?:[ _-]?(?:no|number))?|visa|mastercard)[\s:=\"'#]{1,4}(?P<secret>[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})(?![0-9])", luhn),
    Rule(
        "assigned-secret",
        ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "auth", "credential"),
        r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|credentials?)[A-Za-z0-9_-]*+[\"']?\s*+(?::=|=>|[:=])\s*+(?:[Bb]earer\s)?[\"'`]?(?P<secret>[A-Za-z0-9+/_.=~!@#%^*-]{8,}?)(?=[\"'`\s,;)<]|[.,;]?$|[.,;]\s)",
        min_entropy=2.7,
        run="[A-Za-z0-9_-]",
    ),
    Rule("url-credentials", ("://",), r"://[A-Za-z0-9._~%+-]++:(?P<secret>[^\s:@/\"'<>]{6,}+)@[A-Za-z0-9.-]+", min_entropy=2.0),
)


class Scanner:
    """The automaton and the compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(r, re.compile(r.pattern), re.compile(r.run + "*") if r.run else None) for r in rules]
        by: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                by.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, owners in by.items():
            self.automaton.add_word(k, (len(k), owners))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, str, bool]]:
        """(begin, end, rule, checked), in order and without overlaps; of overlapping ones the first rule's."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        found, tried = [], [0] * len(self.rules)
        for last, (n, owners) in self.automaton.iter(low):
            at = last - n + 1
            for i in owners:
                rule, pattern, run = self.rules[i]
                if run is not None:
                    if at < tried[i]:
                        continue
                    tried[i] = run.match(text, at).end()
                m = pattern.match(text, at)
                if not m:
                    continue
                secret, (begin, end) = m["secret"], m.span("secret")
                sound = rule.check(secret) if rule.check else False
                if (rule.check and rule.strict and not sound) or entropy(secret) < rule.min_entropy:
                    continue
                found.append((begin, end, i, sound))
        out: list[tuple[int, int, int, bool]] = []  # in order, apart from each other
        for f in sorted(set(found), key=lambda f: (f[2], f[0], -f[1])):
            k = bisect_left(out, (f[0],))
            if (not k or out[k - 1][1] <= f[0]) and (k == len(out) or out[k][0] >= f[1]):
                out.insert(k, f)
        return [(b, e, self.rules[i][0].name, s) for b, e, i, s in out]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def findings(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a secret: doc_id, rule, begin and end (characters), length, checked, the start of its SHA-256.

    checked tells that a checksum or structure was right.  The secret itself isn't given.  Null and empty texts
    give no row; rows with a null or repeated id are scanned one by one.
    """
    tune(documents.sparkSession)

    def stage(batches):
        scanner = _scanner(rules)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for begin, end, rule, sound in scanner.scan(text or ""):
                    out.append((row, rule, begin, end, end - begin, sound, hashlib.sha256(text[begin:end].encode()).hexdigest()[:16]))
            if out:
                at, *cols = zip(*out)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "rule", "begin", "end", "length", "checked", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(stage, RESULT)


def redacted(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns; each secret in text is replaced by [rule], and n_chars is counted anew.

    Rows without a secret stay as they are, those with a null or empty text too; repeated rows are scanned one by one.
    """
    tune(documents.sparkSession)
    at_text = documents.columns.index("text")
    at_size = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def stage(batches):
        scanner = _scanner(rules)
        for batch in batches:
            columns, new = list(batch.columns), {}
            for row, text in enumerate(columns[at_text].to_pylist()):
                spans = scanner.scan(text) if text else []
                if spans:
                    starts = [0, *(end for _, end, *_ in spans)]
                    new[row] = "".join(f"{text[a:b]}[{rule}]" for a, (b, _, rule, _) in zip(starts, spans)) + text[starts[-1] :]
            if new:
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[list(new)] = True
                columns[at_text] = pa.compute.replace_with_mask(columns[at_text], pa.array(mask), pa.array(list(new.values()), columns[at_text].type))
                if at_size is not None:
                    columns[at_size] = pa.compute.replace_with_mask(columns[at_size], pa.array(mask), pa.array([len(t) for t in new.values()]).cast(columns[at_size].type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(stage, documents.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_secrets": op5_secrets}
