"""Spelling variants: words that differ by one code point, found in a trie of letter-group counts.

The code points of a word fall into ``GROUPS`` letter groups; the counts of the groups, one after the other, are the word's path in the
trie. One inserted, deleted or replaced code point adds at most one to one count (surplus) and takes at most one from another (deficit),
so a depth-first search that may spend one of each meets every near word; words in the leaves it reaches are compared. Each pair is
searched from one side only: along the path its first difference is a surplus, and in one leaf it starts at the smaller word.

The upper ``depth`` levels deal the trie out: a word is stored in the cell of its own upper path and looks for its likes in the cells that the same
budget reaches. The depth grows until no cell holds more than ``cell_words`` words; a cell that is larger at full depth is cut into blocks,
and every seeker of the cell goes to all of its blocks. Nothing is dropped or capped.

Nulls: a null text has no words; a null id is written as nothing before the colon. Ties of forms go to the smallest word in code-point order; repeated
rows count each. An empty table gives no words. Columns other than ``doc_id`` and ``text`` are ignored, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.llm.common import id_text
from docmerge.session import checkpointed

#: Fixed by the contract: least length and occurrences of a word, the divisor of the hash, and by how much a form outnumbers a word.
LEAST_LENGTH, LEAST_COUNT, DIVISOR, FORM_TIMES = 6, 5, 199, 5
#: Maximal runs of letters; shorter ones than a word give none.
_RUN = re.compile(rf"[A-Za-z\u00C0-\u00FF]{{{LEAST_LENGTH},}}")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
GROUPS = 20
#: Words of one cell that meet in one task; a task holds several cells' words and their seekers.
CELL_WORDS = 8_000
_HELD_WORDS = 200_000


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of the words of whole texts."""
    totals: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            own: Counter[str] = Counter()
            for run, n in Counter(match.group() for match in _RUN.finditer(text or "")).items():
                own[run.lower() if run.isascii() else run.translate(_LOWER)] += n
            before = zlib.crc32(f"{doc_id or ''}:".encode())
            for word, n in own.items():
                h = zlib.crc32(word.encode(), before)
                if h % DIVISOR == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LENGTH:
                        continue
                totals[word] += n
            if len(totals) > _HELD_WORDS:
                yield pd.DataFrame(totals.items(), columns=["word", "n"])
                totals = Counter()
    if totals:
        yield pd.DataFrame(totals.items(), columns=["word", "n"])


def count_words(documents: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts, at least ``least``."""
    source = documents.select(id_text("doc_id"), F.col("text").cast("string"))
    parts = source.mapInPandas(_count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def vector(word: str) -> tuple[int, ...]:
    """How many code points of the word fall into each letter group."""
    counts = [0] * GROUPS
    for c in word:
        counts[ord(c) % GROUPS] += 1
    return tuple(counts)


def cell_name(path: tuple[int, ...]) -> str:
    return ",".join(map(str, path))


def reached(path: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """Cells that the search from the upper path may enter, with the surplus and deficit that are left there: its own, one surplus, or one surplus and a later deficit."""
    here = [str(count) for count in path]
    found = [(",".join(here), 1, 1)]
    for i, count in enumerate(path):
        here[i] = str(count + 1)
        found.append((",".join(here), 0, 1))
        for j in range(i + 1, len(path)):
            if path[j] > 0:
                here[j] = str(path[j] - 1)
                found.append((",".join(here), 0, 0))
                here[j] = str(path[j])
        here[i] = str(count)
    return found


def is_near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    half = len(a) // 2
    if a[:half] != b[:half] and a[half:] != b[half - len(a) :]:  # one edit leaves the first or the last half as it is
        return False
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Trie:
    """Words by the successive counts of their letter groups, from level ``depth`` on."""

    def __init__(self, depth: int = 0) -> None:
        self.root: dict | list = {} if depth < GROUPS else []
        self.depth = depth

    def add(self, word: str, n: int) -> None:
        node = self.root
        path = vector(word)
        for level in range(self.depth, GROUPS):
            node = node.setdefault(path[level], {} if level < GROUPS - 1 else [])
        node.append((word, n))

    def search(self, word: str, surplus: int = 1, deficit: int = 1) -> Iterator[tuple[str, int]]:
        """Near words on paths whose first difference from the word's is a surplus, and larger ones on its own path; the budget is what the upper levels left."""
        path = vector(word)
        work = [(self.root, self.depth, surplus, deficit)]
        while work:
            node, level, surplus, deficit = work.pop()
            if level == GROUPS:
                for other, n in node:
                    if (not surplus or other > word) and is_near(word, other):
                        yield other, n
                continue
            count = path[level]
            if (below := node.get(count)) is not None:
                work.append((below, level + 1, surplus, deficit))
            if surplus:
                if (below := node.get(count + 1)) is not None:
                    work.append((below, level + 1, 0, deficit))
            elif deficit and (below := node.get(count - 1)) is not None:
                work.append((below, level + 1, surplus, 0))


def _depths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cells: Counter[tuple[int, ...]] = Counter()
        for word in batch["word"]:
            path = vector(word)
            cells.update(path[:depth] for depth in range(1, GROUPS + 1))
        yield pd.DataFrame([(len(p), cell_name(p), n) for p, n in cells.items()], columns=["depth", "cell", "n"])


def _routes(depth: int):
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [reached(vector(word)[:depth]) for word in batch["word"]]
            times = [len(c) for c in cells]
            routes = pd.DataFrame([c for every in cells for c in every], columns=["cell", "surplus", "deficit"])
            yield routes.assign(word=batch["word"].repeat(times).to_numpy(), n=batch["n"].repeat(times).to_numpy())[["cell", "word", "n", "surplus", "deficit"]]

    return route


def _pairs(depth: int):
    def find(shard: pd.DataFrame) -> pd.DataFrame:
        tries: dict[tuple[str, int], Trie] = {}
        for cell, block, word, n in shard.loc[shard["stored"], ["cell", "block", "word", "n"]].itertuples(index=False, name=None):
            tries.setdefault((cell, block), Trie(depth)).add(word, n)
        rows = []
        for cell, block, word, n, surplus, deficit in shard[["cell", "block", "word", "n", "surplus", "deficit"]].itertuples(index=False, name=None):
            if (trie := tries.get((cell, block))) is not None:
                rows += [(word, n, other, m) for other, m in trie.search(word, surplus, deficit)]
        return pd.DataFrame(rows, columns=["a", "a_n", "b", "b_n"])

    return find


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """Pairs of near words (``a``, ``a_n``, ``b``, ``b_n``), each once; ``words`` (word, n) holds each word once."""
    total = words.count()
    depth, blocks = 0, None
    if total > cell_words:
        cells = checkpointed(words.mapInPandas(_depths, "depth int, cell string, n long").groupBy("depth", "cell").agg(F.sum("n").alias("n")))
        largest = {r["depth"]: r["n"] for r in cells.groupBy("depth").agg(F.max("n").alias("n")).collect()}  # GROUPS rows
        depth = next((d for d in range(1, GROUPS) if largest[d] <= cell_words), GROUPS)
        if largest[depth] > cell_words:
            blocks = cells.where((F.col("depth") == depth) & (F.col("n") > cell_words)).select("cell", F.ceil(F.col("n") / cell_words).alias("blocks"))
    routes = words.mapInPandas(_routes(depth), "cell string, word string, n long, surplus int, deficit int")
    own = (F.col("surplus") == 1) & (F.col("deficit") == 1)
    if blocks is None:
        routes = routes.withColumns({"block": F.lit(0).cast("long"), "stored": own})
    else:
        count = F.coalesce("blocks", F.lit(1).cast("long"))
        home = F.pmod(F.xxhash64("word"), count)
        routes = routes.join(blocks, "cell", "left").select(*routes.columns, home.alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
        routes = routes.withColumn("stored", own & (F.col("block") == F.col("home"))).drop("home")
    shards = max(1, -(-total // cell_words)) * 2
    dealt = routes.withColumn("shard", F.pmod(F.xxhash64("cell", "block"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pairs(depth), "a string, a_n long, b string, b_n long")


def _with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping; a form has ``FORM_TIMES`` the occurrences of its word, so chains are short and end."""
    roots = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(roots.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return roots


def variants(documents: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """Per word: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    words = checkpointed(count_words(documents))
    pairs = checkpointed(near_pairs(words, cell_words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    fits = -F.col("best.less") >= FORM_TIMES * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
    )
    found = checkpointed(found)
    roots = _with_roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
