"""URL rules as a bit-parallel wildcard automaton.

All glob patterns are laid out in one bit vector of 64-bit words, one bit per state. Reading a
character ``c`` updates the states of every pattern at once (Shift-And with wildcard loops)::

    states = (states << 1 & reached_by[c]) | (states & stays_on[c])

``?`` is any character but ``/``, ``*`` any run without ``/``, ``**`` any run. A batch of URLs is read
column by column, longest first, so memory grows with the batch's characters only.

- A NULL URL, or one without ``://``, has an empty host and path; no rule of a host fits it.
- Of equally long rules that fit, the one listed first wins.
- Result columns replace columns of the same name; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscale.llm.common import LOWER, UPPER

ANY, NO_SLASH = "**", "*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        """The host itself and its subdomains, with every path that begins with the rule's."""
        return f"{self.text}{ANY}", f"{NO_SLASH}.{self.text}{ANY}"


def canonical_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


class GlobAutomaton:
    """All patterns packed into multiword masks; ``match`` simulates them together."""

    def __init__(self, patterns: Sequence[str]):
        parsed = [self._parse(p) for p in patterns]
        letters = sorted({s for symbols, _ in parsed for s in symbols if s != "?"} | {"/"})
        self.codes = np.array([ord(c) for c in letters], dtype=np.uint32)
        total = sum(len(symbols) + 1 for symbols, _ in parsed)
        self.words = max(1, -(-total // 64))
        # Class 0 is every character that no pattern names.
        self.reached = np.zeros((len(letters) + 1, self.words), dtype=np.uint64)
        self.stays = np.zeros_like(self.reached)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.finals: list[int] = []
        slash = 1 + letters.index("/")
        at = 0
        for symbols, loops in parsed:
            self._set(self.start, at)
            for i, symbol in enumerate(symbols, 1):
                for k in range(len(letters) + 1):
                    if k != slash if symbol == "?" else k and letters[k - 1] == symbol:
                        self._set(self.reached[k], at + i)
            for i, loop in loops.items():
                for k in range(len(letters) + 1):
                    if loop == ANY or k != slash:
                        self._set(self.stays[k], at + i)
            self.finals.append(at + len(symbols))
            at += len(symbols) + 1

    @staticmethod
    def _parse(pattern: str) -> tuple[list[str], dict[int, str]]:
        """The symbols, and which states (after so many symbols) have a wildcard loop."""
        symbols: list[str] = []
        loops: dict[int, str] = {}
        i = 0
        while i < len(pattern):
            if pattern[i] == "*":
                run = i
                while i < len(pattern) and pattern[i] == "*":
                    i += 1
                state = len(symbols)
                if i - run > 1 or loops.get(state) != ANY:
                    loops[state] = ANY if i - run > 1 else NO_SLASH
                continue
            symbols.append(pattern[i])
            i += 1
        return symbols, loops

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """A boolean matrix: does pattern ``j`` accept the whole of text ``i``."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        near = np.minimum(np.searchsorted(self.codes, chars), len(self.codes) - 1)
        classes = np.where(self.codes[near] == chars, near + 1, 0)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else lengths
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        states = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for column in range(int(lengths[0]) if len(texts) else 0):
            active = int(np.searchsorted(-lengths, -column, side="left"))
            now, read = states[:active], classes[begins[:active] + column]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            states[:active] = (moved & self.reached[read]) | (now & self.stays[read])
        out = np.empty((len(texts), len(self.finals)), dtype=bool)
        for j, bit in enumerate(self.finals):
            out[order, j] = (states[:, bit // 64] >> np.uint64(bit % 64)) & one
        return out


def judge_urls(
    df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (NULL if none fits) and ``verdict``; one narrow pass."""
    ranked = sorted(rules, key=lambda r: -len(r.text))
    automaton = GlobAutomaton([g for r in ranked for g in r.globs])

    @F.pandas_udf("int")
    def first_rule(urls: pd.Series) -> pd.Series:
        hit = automaton.match(urls.tolist()).reshape(len(urls), len(ranked), 2).any(axis=2)
        return pd.Series(np.where(hit.any(axis=1), hit.argmax(axis=1) if ranked else 0, -1), dtype="int32")

    host, path = canonical_parts(F.col(url))
    names = F.array(*[F.lit(r.text) for r in ranked]).cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in ranked]).cast("array<string>")
    judged = df.withColumns({"host": host, "path": path})
    judged = judged.withColumn("__rule", first_rule(F.concat("host", "path")))
    found = F.col("__rule") >= 0
    return judged.withColumns(
        {
            "rule": F.when(found, F.get(names, F.col("__rule"))),
            "verdict": F.when(found, F.get(verdicts, F.col("__rule"))).otherwise(F.lit(default)),
        }
    ).drop("__rule")
