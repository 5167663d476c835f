"""Encoding with a public byte-level BPE vocabulary (problem 7).

A batch of texts is split into words by the vocabulary's pattern; its distinct words lie in one token list.
A pair occurrence index maps each adjacent pair that has a merge to all its positions in that list. Active
ranks are applied in ascending order, each at all its positions at once, and the index is updated for the
neighbours. Word ids are then put together per document.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("COHORTLOOM_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the word pattern of the vocabulary, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Texts encoded at a time, and words kept with their ids between batches of a task.
TEXTS, MEMO = 2_000, 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others,
    in order, for the code points from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def load(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """Ids of the 256 bytes, and the rank and id of each merge by its pair of ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return [vocab[c] for c in byte_letters()], {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}


def encode_words(words: list[bytes], first: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """Token ids of each word, all words at once by a pair occurrence index.

    A merge makes a token that only merges of later rank use, so one ascending pass over the ranks of the
    whole partition gives what each word would give alone.
    """
    token: list[int] = []
    after: list[int] = []
    starts: list[int] = []
    for w in words:
        n = len(token)
        starts.append(n)
        token.extend(map(first.__getitem__, w))
        after.extend(range(n + 1, len(token) + 1))
        if w:
            after[-1] = -1
    before = [-1] * len(token)
    for i, j in enumerate(after):
        if j >= 0:
            before[j] = i
    index: dict[tuple[int, int], list[int]] = {}
    active: list[tuple[int, tuple[int, int]]] = []

    def note(pair: tuple[int, int], at: int) -> None:
        places = index.get(pair)
        if places is not None:
            places.append(at)
        elif pair in merges:
            index[pair] = [at]
            heapq.heappush(active, (merges[pair][0], pair))

    for i, j in enumerate(after):
        if j >= 0:
            note((token[i], token[j]), i)
    while active:
        _, pair = heapq.heappop(active)
        a, b = pair
        new = merges[pair][1]
        for i in sorted(index.pop(pair)):
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue  # a former merge took one of the two
            k = after[j]
            token[i], token[j], after[i] = new, -1, k
            if k >= 0:
                before[k] = i
                note((new, token[k]), i)
            h = before[i]
            if h >= 0:
                note((token[h], new), h)
    out = []
    for s, w in zip(starts, words):
        ids = []
        i = s if w else -1
        while i >= 0:
            ids.append(token[i])
            i = after[i]
        out.append(ids)
    return out


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (token ids by byte_bpe_50k, without special tokens) of each row's text.

    ``documents`` has doc_id and text; other columns are not read. Empty and null texts give an empty list;
    strings that look like special tokens are ordinary text; a text of any length is encoded whole; repeated
    rows each give a row, as does a null doc_id. No shuffle. The merge table (about 50,000 entries, fixed by
    the vocabulary) is broadcast, so executors need no file.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load(path or os.path.join(TOKENIZERS, "byte_bpe_50k.json")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, merges = shared.value
        words = regex.compile(PATTERN)
        memo: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                split = [words.findall(t) if t else [] for t in part.column("text").to_pylist()]
                if len(memo) > MEMO:
                    memo.clear()
                new = list({w for ws in split for w in ws if w not in memo})
                memo.update(zip(new, encode_words([w.encode("utf-8", "surrogatepass") for w in new], first, merges)))
                flat: list[int] = []
                ends = [0]
                for ws in split:
                    for w in ws:
                        flat.extend(memo[w])
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
