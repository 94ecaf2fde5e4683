"""URL rules by a bit-parallel wildcard automaton over canonical URLs.

Every rule is a glob over the canonical URL ``.host/path``; ``*`` matches anything and ``~`` anything without a slash,
so that a host pattern ends with the host. The positions of all globs lie side
by side in a few machine words. One step reads one character of every URL of a batch: shift the active positions, keep
those whose character fits (Shift-And), and let positions before a ``*`` stay active.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.llm.batches import slices, text_bytes

# Rules as (verdict, host, path) ...
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# ... and the globs of this operator, which judge a URL that no rule fits.
BLOCK_GLOBS = (".~casino~/*", ".~cheap-pills~/*", ".~.adserver.~/*", ".~/ads/*", ".~/*/ads/*", ".~/wp-login*",
               ".~.onion/*")


@dataclass
class Automaton:
    """Globs packed into words of 64 positions; bit p of glob g is set when its first p characters have matched."""

    globs: tuple[str, ...]

    def __post_init__(self):
        start, masks, loops, finals = [], {}, {"*": [], "~": []}, []
        at = 0
        for glob in self.globs:
            start.append(at)
            for byte in glob.encode():
                if chr(byte) in loops:
                    loops[chr(byte)].append(at)
                else:
                    masks.setdefault(byte, []).append(at + 1)
                    at += 1
            finals.append(at)
            at += 1
        self.words = at // 64 + 1
        self.start = self._pack(start)
        self.loops = np.repeat(self._pack(loops["*"] + loops["~"])[None, :], 256, 0)  # by the character read
        self.loops[ord("/")] = self._pack(loops["*"])
        self.table = np.zeros((256, self.words), np.uint64)
        for byte, places in masks.items():
            self.table[byte] = self._pack(places)
        self.finals = finals

    def _pack(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in places:
            out[p // 64] |= np.uint64(1) << np.uint64(p % 64)
        return out

    def match(self, texts: pa.Array) -> np.ndarray:
        """Rows x globs: whether the glob matches the whole text."""
        data, offsets = text_bytes(texts)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")  # texts still being read are the first ones
        first, lengths = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start[None, :], len(order), 0)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))
            old = state[:live]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            read = data[first[:live] + step]
            state[:live] = (moved & self.table[read]) | (old & self.loops[read])
        out = np.zeros((len(order), len(self.globs)), bool)
        for g, place in enumerate(self.finals):
            out[order, g] = (state[:, place // 64] >> np.uint64(place % 64)) & np.uint64(1) == 1
        return out


def rule_glob(host: str, path: str) -> str:
    """Glob of a host with all its subdomains and of paths that start with ``path``."""
    return f".~.{host}{path}*"


def canonical(url):
    """(host, path) of a URL column; both empty for null and for what has no ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _judge(rules, block_globs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the leading dot of ".host" also stands before a host that is the rule's own
        exact = [f".{h}{p}*" for _, h, p in rules]
        machine = Automaton(tuple(exact + [rule_glob(h, p) for _, h, p in rules] + list(block_globs)))
        names = [h + p for _, h, p in rules]
        by_length = sorted(range(len(rules)), key=lambda i: (-len(names[i]), names[i]))
        for batch in slices(batches, "address"):
            hit = machine.match(batch.column("address"))
            n = len(rules)
            fits = hit[:, :n] | hit[:, n:2 * n]
            # an empty path reads as "/" for the globs, but a rule with a path asks for one
            fits[np.ix_(batch.column("path").to_numpy(zero_copy_only=False) == "", [p != "" for _, _, p in rules])] = False
            rule = np.full(batch.num_rows, -1)
            for i in reversed(by_length):
                rule[fits[:, i]] = i
            blocked = hit[:, 2 * n:].any(1)
            verdict = [rules[r][0] if r >= 0 else "block" if b else "allow" for r, b in zip(rule.tolist(), blocked.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(c for c, f in zip(batch.columns, batch.schema.names) if f != "address"),
                 pa.array([names[r] if r >= 0 else None for r in rule.tolist()], pa.string()), pa.array(verdict, pa.string())],
                [*(f for f in batch.schema.names if f != "address"), "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules=RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's; of several the longest wins (then the
    first by name). Without a rule the globs decide, for which a host without a path has the path "/": one that matches
    blocks, else the URL is allowed; so are null, empty and unparsable URLs, whose host and path are empty. The host is lower-cased (A-Z), a port or user part is
    kept as written. Other columns are ignored; rows may repeat; an empty table gives no rows.
    """
    source = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = canonical(F.col("url"))
    parts = source.select("page_id", host.alias("host"), path.alias("path"))
    shown = F.when((F.col("path") == "") & (F.col("host") != ""), F.lit("/")).otherwise(F.col("path"))
    parts = parts.withColumn("address", F.concat(F.lit("."), "host", shown))
    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(_judge(tuple(rules), tuple(block_globs)),
                            f"page_id {kind}, host string, path string, rule string, verdict string")
