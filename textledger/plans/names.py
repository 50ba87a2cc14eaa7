"""Dictionary matching: names in texts, by containment, at word borders, or by the longest run of words.

Names are a dictionary that may be large: they are matched in blocks of at most
``BLOCK_CHARS`` characters (a key's names stay together), each a matcher that
goes with the code to the rows, where they lie. A row passes all blocks in one
stage and takes along, for every place, the longest name found so far: no
shorter one at that place can be chosen, whichever block it is in. Only behind
the last block are overlaps decided, so the blocks' size changes no result, and
nothing is shuffled. Null texts and null or empty names match nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType

from ..functions.rowwise import of_two
from ..functions.tokens import mask, spans, unmask_parts

BLOCK_CHARS = 8_000_000


def name_blocks(names: DataFrame, *columns: str) -> Iterator[list[tuple]]:
    """Distinct rows of ``columns``, the last of which is the name, in blocks of bounded size that part no rows of equal first columns."""
    block, size = [], 0
    found = names.select(*columns).where(F.length(columns[-1]) > 0).distinct()
    for row in found.orderBy(*columns).toLocalIterator():
        if block and size + len(row[-1]) > BLOCK_CHARS and (len(columns) == 1 or block[-1][:-1] != tuple(row)[:-1]):
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += len(row[-1])
    if block:
        yield block


def _automaton(words: dict):
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, what in words.items():
        found.add_word(word, (len(word), what))
    found.make_automaton()
    return found


def contained(rows: DataFrame, key: str, text: str, names: DataFrame, name_key: str, name: str) -> DataFrame:
    """``key, name_key`` of every text and name it contains, each pair once for a row."""
    schema = StructType([rows.schema[key], names.schema[name_key]])
    out = rows.sparkSession.createDataFrame([], schema)
    for block in name_blocks(names, name_key, name):
        shared = rows.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS at most, or one name

        def find(batches, shared=shared):
            by: dict[str, list] = {}
            for number, word in shared.value:
                by.setdefault(word, []).append(number)
            auto = _automaton(by)
            for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
                hits = [sorted({n for _, (_, numbers) in auto.iter(t) for n in numbers}) if t else [] for t in batch.column(text).to_pylist()]
                rows_ = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
                found = pa.array([n for h in hits for n in h], to_arrow_type(schema[name_key].dataType))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(rows_), found], names=[key, name_key])

        out = out.union(rows.select(key, text).mapInArrow(find, schema))
    return out


def folded(text: str) -> tuple[str, list[int] | None]:
    """The case-folded text, and for each of its places (and its end) the place of the text, or -1 within a letter that folds to several; None where they are the same."""
    low = text.casefold()
    if len(low) == len(text):
        return low, None
    places: list[int] = []
    for i, c in enumerate(text):
        places += [i, *[-1] * (len(c.casefold()) - 1)]
    return low, [*places, len(text)]


def _at_borders(text: str, a: int, b: int) -> bool:
    inside = (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b - 1].isalnum() and text[b].isalnum())
    return not inside


def border_hits(text: str, auto) -> dict[int, int]:
    """Begin and end of the longest dictionary name that begins at each place, ignoring case, at word borders."""
    low, places = folded(text)
    best: dict[int, int] = {}
    for end, (n, _) in auto.iter(low):
        a, b = end + 1 - n, end + 1
        if places:
            a, b = places[a], places[b]
        if a >= 0 and b > best.get(a, 0) and _at_borders(text, a, b):
            best[a] = b
    return best


def leftmost(best: dict[int, int]) -> list[tuple[int, int]]:
    """Of spans by begin those that are left when each takes its place from the left, none overlapping."""
    out, free = [], 0
    for a in sorted(best):
        if a >= free:
            out.append((a, best[a]))
            free = best[a]
    return out


def passed(rows: DataFrame, keep: list[str], text: str, blocks: Iterator[list[tuple]], build: Callable, find: Callable, choose: Callable | None, last: str) -> DataFrame | None:
    """``keep``, ``text`` and ``found``: rows past all blocks of names; None where there are none.

    ``build`` makes a matcher of a block, ``find`` gives what it finds in a text
    by place, of which the greatest stays, and ``choose`` makes of all that what
    the last block writes (type ``last``). Without ``choose`` what is found is
    lists by any key, which are joined, and ``last`` is the type of all blocks.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in dict.fromkeys([*keep, text])}
    between = "map<int,int>" if choose else last
    frame = rows.select(*kinds).withColumn("found", F.lit(None).cast(between))
    block = next(blocks, None)
    if block is None:
        return None
    while block is not None:
        after = next(blocks, None)
        shared = rows.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS, or the names of one key

        def step(t, old, shared=shared, done=after is None, made=[]):  # noqa: B006  a task's own matcher
            if not made:
                made.append(build(shared.value))
            best = dict(old) if old is not None else {}
            for place, n in (find(t, made[0]) if t else {}).items():
                best[place] = max(n, best.get(place, 0)) if choose else [*best.get(place, []), *n]
            return choose(t, best) if done and choose else best

        frame = frame.withColumn("found", F.udf(step, last if after is None else between, useArrow=False)(F.col(text), F.col("found")))
        block = after
    return frame


def _scanned(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame | None:
    build = lambda block: _automaton({w.casefold(): None for (w,) in block})
    return passed(rows, [key], text, name_blocks(names, name), build, border_hits, lambda t, best: [list(x) for x in leftmost(best)], "array<array<int>>")


def scan(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """``key, start, end, name``: names at word borders in each text, ignoring case, leftmost and longest, none overlapping; places are the text's own."""
    found = _scanned(rows, key, text, names, name)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, start int, end int, name string")
    each = found.select(key, text, F.explode("found").alias("h")).select(key, text, F.col("h")[0].alias("start"), F.col("h")[1].alias("end"))
    return each.select(key, "start", "end", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("name"))


_GENITIVE = re.compile(r"['’]s(?![^\W_])", re.IGNORECASE)


def genitive(name: str) -> str:
    """The Turkish genitive suffix of a name, by its last vowel."""
    vowels = [c for c in name.casefold() if c in "aeıioöuü"]
    last = vowels[-1] if vowels else "a"
    sound = "iüuı"[("ei".find(last) < 0) + ("eiöü".find(last) < 0) + ("eiöüou".find(last) < 0)]
    return "'" + ("n" if name[-1:].casefold() in set("aeıioöuü") else "") + sound + "n"


def protect(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """``key, masked, tokens``: tokens and names (found as by ``scan``) as private characters, for texts that go to a provider.

    A name's English genitive is hidden with it and comes back as the Turkish
    one. ``restored`` undoes it. Texts without names have their tokens masked only.
    """
    found = _scanned(rows, key, text, names, name)
    if found is None:
        found = rows.select(key, text).withColumn("found", F.array().cast("array<array<int>>"))

    def cover(t: str, hits) -> tuple[str, list[str]]:
        also = []
        for a, b in hits if hits is not None else []:
            said = _GENITIVE.match(t, b)
            also.append((a, said.end(), t[a:b] + genitive(t[a:b])) if said else (a, b, t[a:b]))
        return mask(t, also)

    covered = F.udf(lambda t, hits: None if t is None else cover(t, hits), "masked string, tokens array<string>", useArrow=False)
    return found.select(key, covered(text, "found").alias("m")).select(key, "m.masked", "m.tokens")


def _is_format(token: str) -> bool:
    whole = spans(token)
    return token in ("{", "}", ":", "?") or (len(whole) == 1 and whole[0][1] - whole[0][0] == len(token))


def restore(masked: str, tokens: list[str]) -> str | None:
    """The text with names and tokens back, or null if any is lost or doubled. Letters that a provider set right beside a name are parted from it by a blank."""
    parts = unmask_parts(masked, tokens)
    if parts is None:
        return None
    out = []
    for i, part in enumerate(parts):
        beside = [p for p in (i - 1, i + 1) if 0 <= p < len(parts) and i % 2 == 0 and not _is_format(parts[p])]
        left = i - 1 in beside and part[:1].isalpha()
        right = i + 1 in beside and part[-1:].isalpha()
        out.append(" " * left + part + " " * right)
    return "".join(out)


#: ``restore`` of two columns.
restored = of_two(restore, StringType())


_JOINED = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SUFFIX = re.compile(r"['’][^\W\d_]+\Z")


def _trie(block: list[tuple]) -> dict:
    """Names as paths of words; the key None ends one."""
    root: dict = {}
    for (name,) in block:
        node = root
        for word in _JOINED.findall(name):
            node = node.setdefault(word, {})
        if node is not root:
            node[None] = True
    return root


def word_hits(widest: int, text: str, trie: dict) -> dict[int, int]:
    """For each word of the text at which names begin, twice the words of the longest one, and one more if it is there without a suffix to its last word."""
    words = _JOINED.findall(text)
    best = {}
    for i in range(len(words)):
        node = trie
        for n, word in enumerate(words[i : i + widest], 1):
            if None in node.get(word, ()):
                best[i] = 2 * n + 1
            elif None in node.get(_SUFFIX.sub("", word), ()):
                best[i] = 2 * n
            node = node.get(word)
            if node is None:
                break
    return best


def longest_matches(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, widest: int = 8) -> DataFrame:
    """Leftmost-longest, non-overlapping dictionary names of up to ``widest`` words in each text: ``key, names`` in text order.

    Words may hold apostrophes and hyphens; a name also matches where its last
    word has a suffix behind an apostrophe, and is then given without it,
    unless the dictionary has it with the suffix too. Names are paths of words
    in a trie, walked from every word.
    """

    def choose(t: str, best: dict[int, int]) -> list[str]:
        words = _JOINED.findall(t or "")
        spans_ = leftmost({i: i + n // 2 for i, n in best.items()})
        return [" ".join([*words[a : b - 1], words[b - 1] if best[a] % 2 else _SUFFIX.sub("", words[b - 1])]) for a, b in spans_]

    kind = rows.schema[key].dataType.simpleString()
    found = passed(rows, [key], text, name_blocks(names, name), _trie, lambda t, trie: word_hits(widest, t, trie), choose, "array<string>")
    if found is None:
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, names array<string>")
    return found.where(F.size("found") > 0).select(key, F.col("found").alias("names"))
