"""Secret scans over an incremental blob ledger.

Every version of every text is a blob, addressed by its SHA-256. A ledger holds what was found in
each pair of blob and rule-set version. A scan takes the distinct blobs of the new versions, drops
the pairs that the ledger has, scans what is left once, and joins findings back to all rows (paths)
that carry the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, hot_keys, split_join


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``hint``: texts that hold none of these (in lower case) cannot match. ``span``: the group that is the finding."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hint: tuple[str, ...] = ()
    span: int = 0


#: The base rules, in the order in which ties of spans are listed (fixed values of the contract).
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, False, ("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", 32),  # a run of 32 or more is the same match as a run of which 32 are required
)

#: A private key: to the END line of its kind, or else over the header fields and lines of base64 that follow, of which the last may be short.
_BREAK = r"(?:\s|\\[rn])"
_LINE, _ENDS = r"[\x20\t]*+(?:\r?\n|\\[rn])++[\x20\t]*+", r"""(?=[\x20\t]*+(?:\r?\n|\\[rn]|["'`<\\]|\Z))"""
_KEY = (
    r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY( BLOCK|)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY\2-----"
    rf"|(?:(?:{_BREAK}++[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)*+(?:{_BREAK}++[A-Za-z0-9+/=]{{16,}}+)++(?:{_LINE}[A-Za-z0-9+/]++={{0,2}}+{_ENDS})?+(?:{_LINE}=[A-Za-z0-9+/]{{4}}{_ENDS})?+)?)"
)
#: The start of a scheme: the first letter after a word's edge in a run of its characters, from which the whole run is read once.
_SCHEME = r"(?<![A-Za-z0-9+.-])(?:(?:(?<=_)|(?![A-Za-z]))[A-Za-z0-9]*+(?:[+.-]++(?:[0-9][A-Za-z0-9]*+)?+)*+)?+"

#: Further kinds that this scan adds.
ADDED = (
    Rule("pem", _KEY, 0, 0, False, ("private key",)),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False, ("gh",)),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False, ("xox",)),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++", 0, 0, False, ("eyj",)),  # a run of its letters is tried once
    Rule("url", _SCHEME + r"([A-Za-z][A-Za-z0-9+.-]++://[^\s/:@]++:[^\s/:@]{3,}+@)", 0, 0, False, ("://",), 1),
)

RULES = BASE + ADDED


def version_of(rules: tuple[Rule, ...] = RULES) -> str:
    """The version of a rule set: the digest of its rules."""
    return sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r.kind, re.compile(r.pattern, re.ASCII | re.IGNORECASE if r.any_case else re.ASCII), r.least, r.group, r.hint, r.span) for r in rules]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all findings by start, then kind in the rules' order; code points, end exclusive."""
        low, found = text.lower(), []
        for k, (kind, pattern, least, group, hint, span) in enumerate(self.rules):
            if hint and not any(h in low for h in hint):
                continue
            found += [(m.start(span), k, kind, m.end(span)) for m in pattern.finditer(text) if len(m[group]) >= least]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]


FINDINGS = "blob binary, rules string, kinds array<string>, starts array<bigint>, ends array<bigint>"


def address(text: str = "text"):
    """The blob address of a text; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """FINDINGS of rows (blob, text): one row a blob, with empty arrays where nothing was found."""
    version = version_of(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [scanner.spans(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([version] * len(found)), *(pa.array([[s[i] for s in spans] for spans in found], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64())))],
                    ["blob", "rules", "kinds", "starts", "ends"],
                )

    return blobs.select("blob", "text").mapInArrow(run, FINDINGS)


def _hot(addresses: DataFrame) -> DataFrame | None:
    """Blobs that many of the rows (blob) carry, as for split_join."""
    return gathered(hot_keys(addresses.groupBy("blob").agg(F.count(F.lit(1)).alias("n")), ["blob"], addresses.count()))


def new_findings(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", hot: DataFrame | None = None) -> DataFrame:
    """FINDINGS of the blobs in ``versions`` that the ledger (FINDINGS rows) lacks for these rules: what to append to it.

    One row of each blob is chosen by its address and a hash of its id (40 bytes a row are shuffled);
    only then do texts move, by both, so a blob with a third of all rows is not gathered. The texts
    of hot blobs (blob, parts) are instead collapsed where they are read.
    """
    version = version_of(rules)
    texts = versions.select(F.xxhash64(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", address())
    chosen = texts.groupBy("blob").agg(F.min("row").alias("row"))
    if ledger is not None:
        chosen = chosen.join(ledger.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
    if hot is None:
        unseen = texts.join(chosen.hint("shuffle_hash"), ["blob", "row"]).select("blob", "text")
    else:
        few = F.broadcast(hot.select("blob"))  # two a partition at most
        rest = texts.join(few, "blob", "left_anti").join(chosen.hint("shuffle_hash"), ["blob", "row"]).select("blob", "text")
        most = texts.join(F.broadcast(chosen.join(few, "blob", "left_semi").select("blob")), "blob", "left_semi").groupBy("blob").agg(F.min("text").alias("text"))
        unseen = rest.unionByName(most)
    # rows that repeat an id may bring a blob's text twice: the findings are equal then, and one is kept
    return scan_blobs(unseen, rules).dropDuplicates(["blob"])


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row of ``versions``: id, blob, kinds, starts, ends (parallel arrays by start).

    Null texts count as empty; repeated rows each get their row; an empty table gives an empty
    result; other columns are not read. ``ledger`` (FINDINGS rows) saves scanning what it has;
    append ``new_findings`` to it after a scan. Rows of a blob with more than a partition's share
    of them are dealt to parts.
    """
    paths = versions.select(F.col(id_col), address(text_col).alias("blob"))
    hot = _hot(paths.select("blob"))
    hits = _hits(versions, ledger, rules, id_col, text_col, hot)
    empty = [F.coalesce(F.col(c), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("kinds", "string"), ("starts", "bigint"), ("ends", "bigint"))]
    return split_join(paths, hits, ["blob"], hot, [id_col], "left").select(id_col, "blob", *empty)


def _hits(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], id_col: str, text_col: str, hot: DataFrame | None) -> DataFrame:
    """FINDINGS of the blobs of versions in which something was found."""
    found = new_findings(versions, ledger, rules, id_col, text_col, hot)
    if ledger is not None:
        found = found.unionByName(ledger.where(F.col("rules") == version_of(rules)).select(*found.columns).dropDuplicates(["blob"]))
    return found.where(F.size("kinds") > 0)


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every finding in the text replaced by ``mark`` (overlapping ones by one); all rows and columns stay.

    A null text stays null. Rows that carry a hot blob are dealt to parts.
    """
    hot = _hot(docs.select(address(text_col).alias("blob")))
    found = _hits(docs, ledger, rules, id_col, text_col, hot).select(F.col("blob").alias("__blob"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))

    @F.arrow_udf("string")
    def masked(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for text, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if text is not None and a:
                parts, at = [], 0
                for s, e in sorted(zip(a, b)):
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    hot = hot.withColumnRenamed("blob", "__blob") if hot is not None else None
    keyed = split_join(docs.withColumn("__blob", address(text_col)), found, ["__blob"], hot, [id_col], "left")
    return keyed.select(*[masked(F.col(text_col), F.col("__starts"), F.col("__ends")).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])
