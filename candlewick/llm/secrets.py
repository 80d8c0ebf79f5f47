"""Secrets in texts: all rules in one automaton, one pass over the bytes of each batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.automaton import BETWEEN, Automaton, begin, compiled, scan
from candlewick.llm.shared import narrow, slices, utf8


@dataclass(frozen=True)
class Rule:
    """core: pattern whose every match shows that a secret may be here and ends where its earliest match can end.

    full: what is found from the core's start, greedy; its last group, or all of it, must have `least` characters. A short match is
    dropped, but takes its place. A match must not contain the start of another that ends before the first one's core does.
    """

    kind: str
    core: str
    full: str
    least: int


#: What stands between the lines of a key: white space, also spelled as an escape, quotes and marks of quoted text.
GAP = r"(?:\s|\\[nrt]|[\"'`,;>|#*])"
#: The rest of a private key: all up to its END line if no other such line comes before, else header lines and lines of base64; the last may be short.
BODY = (r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
        rf"|(?:{GAP}+[A-Za-z-]+:\x20[^\r\n]*)*(?:{GAP}+[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:{GAP}+(?:[A-Za-z0-9+/]+=+|[A-Za-z0-9+/]+(?=\s*(?:[\r\n]|\Z))))?)?")

#: The base rules, then formats of credentials as their issuers publish them. Fixed values.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\x2d]",
         r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    Rule("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]+", 24),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9\x2d]", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("maps", r"AIza[A-Za-z0-9_\x2d]", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("signed", r"eyJ[A-Za-z0-9_\x2d]+\.eyJ[A-Za-z0-9_\x2d]+\.[A-Za-z0-9_\x2d]", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("private", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----" + BODY, 1),
)
BASE = ("assign", "access", "hex")


@lru_cache(4)
def machines(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton], list[re.Pattern]]:
    """The automaton over all cores, one backward automaton per core, and the expressions that extend a match."""
    return (compiled([r.core for r in rules]), [compiled([r.core], anywhere=False, backward=True) for r in rules],
            [re.compile(r.full.encode()) for r in rules])


def found(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule, end) in code points, in that order."""
    forward, backward, extend = machines(rules)
    data = bytes([BETWEEN]).join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    ends, bits = scan(np.frombuffer(data, np.uint8), forward)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    done: dict[tuple[int, int], int] = {}  # end of the last match of a text and rule
    for end, owner, bit in zip(ends.tolist(), (np.searchsorted(begins, ends - 1, "right") - 1).tolist(), bits.tolist(), strict=True):
        for k, rule in enumerate(rules):
            if not bit >> k & 1:
                continue
            first = int(begins[owner])
            last = done.get((owner, k), first)
            if end <= last:
                continue
            start = begin(data, end, last, backward[k])
            if start < 0:
                continue
            match = extend[k].match(data, start, first + int(lengths[owner]))
            done[owner, k] = match.end()
            if len(match[match.lastindex or 0]) >= rule.least:
                out[owner].append((match.start() - first, k, match.end() - first))
    for text, spans in zip(texts, out, strict=True):
        if spans and not text.isascii():
            spans[:] = [(len(text[:a].decode()), k, len(text[:b].decode())) for a, k, b in spans]
        spans.sort()
    return out


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per row of docs; spans are structs (kind, start, end) in code points, by start, then rule order.

    Matches of a kind are the leftmost ones without overlap; kinds may overlap each other. Null and empty texts have none. Repeated
    rows and null ids are kept as they are.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in found(utf8(batch.column(1)), rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["doc_id", "spans"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "<{}>") -> DataFrame:
    """docs with every secret in the text replaced by its kind; overlapping secrets become one mark, of the first kind. Other columns stay."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            values = batch.column(at).to_pylist()
            for row, hits in enumerate(found([(v or "").encode() for v in values], rules)):
                text, parts, done = values[row], [], 0
                for a, k, b in hits:
                    if a >= done:
                        parts += [text[done:a], mark.format(rules[k].kind)]
                    done = max(done, b)
                if hits:
                    values[row] = "".join([*parts, text[done:]])
            columns = batch.columns
            columns[at] = pa.array(values, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def listed(spans_col: str = "spans", kinds: tuple[str, ...] | None = None):
    """kind:start:end of each span, comma-joined; only the given kinds if there are any."""
    chosen = F.col(spans_col) if kinds is None else F.filter(spans_col, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
