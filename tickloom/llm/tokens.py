"""Token counts and ids of whole texts, encoded in batches inside Arrow tasks."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import byte_bounded, utf8

#: Bytes of text that are encoded together.
GROUP_BYTES = 1 << 20
#: Parts of texts whose tokens a worker remembers; beyond it, it starts anew.
MEMORY = 600_000
#: Bytes after which a part that can't be remembered is cut at the next safe boundary.
LONG_PART = 1 << 16
#: Stands for the ids of a part that ends in white space.
ODD = 0


def groups_by_bytes(texts: list[bytes], most: int = GROUP_BYTES) -> Iterable[range]:
    """Runs of texts of about ``most`` bytes each, so that batches are even whatever the texts' lengths."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield range(first, i + 1)
            first, held = i + 1, 0
    if first < len(texts):
        yield range(first, len(texts))


class PieceCounter:
    """Counts as a sentencepiece BPE model gives them.

    No piece of the model has a space mark after another character, so no merge crosses the place between
    a character and a space that follows it: that is a safe boundary, and the parts between
    boundaries are encoded alone. The space at a part's head is the one the model puts before any text. The property
    is checked when the model is loaded; a model without it, or one that normalises texts, encodes whole texts.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        kept = all(self.model.decode(self.model.encode(x)) == x for x in ("a  b", " ﬁ ½ ", "É e"))
        self.splits = kept and not any(self.MARK in piece.lstrip(self.MARK) for piece in pieces)
        self.known: dict[str, int] = {}
        self.safe = re.compile(f"(?<=[^ {self.MARK}]) (?=[^ {self.MARK}])")

    def _lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.model.encode(texts, num_threads=1)))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self._lengths(texts)
        parts = [text.split(" ") for text in texts]
        for i, text in enumerate(texts):
            if "" in parts[i] or self.MARK in text:  # runs of spaces: cut only where one space stands alone
                parts[i] = self._long_parts(text)
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list({x for own in parts for x in own if x not in self.known})
        self.known.update(zip(new, self._lengths(new)))
        known = self.known.__getitem__
        return [sum(map(known, own)) if text else 0 for text, own in zip(texts, parts)]

    def _long_parts(self, text: str) -> list[str]:
        out, first = [], 0
        for at in self.safe.finditer(text):
            if at.start() - first >= LONG_PART:
                out.append(text[first : at.start()])
                first = at.end()
        return [*out, text[first:]]


class BytePairIds:
    """Ids as the byte-level BPE of a tokenizers file gives them, as little-endian unsigned 32-bit bytes.

    The file's splitting rule never joins a character and white space that follows it, so a text is cut
    before each space that follows another character, and each part is encoded once and remembered. Texts
    with white space before a space, where the rule looks further back, are encoded whole. New parts go through the
    ranks of the same vocabulary where a rank file is given, which is faster; their ids are the same.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        (self.line_end,) = self.model.encode("\n", add_special_tokens=False).ids
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        if self.quick is not None:
            encode = self.quick.encode_ordinary
            return [np.array(encode(x), "<u4").tobytes() for x in texts]
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without line ends, encoded at once: the line end put between two is a token of its own."""
        if not parts:
            return []
        ids = np.frombuffer(self._plain(["\n".join(parts)])[0], "<u4")
        cuts = np.flatnonzero(ids == self.line_end)
        whole, starts, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
        return [whole[a:b] for a, b in zip(starts, ends, strict=True)]

    def _learn(self, parts: set[str]) -> None:
        """Remember the ids of parts that follow a space; those that end in white space are only marked."""
        odd = [x for x in parts if not x or x[-1].isspace()]
        self.later.update(dict.fromkeys(odd, ODD))
        lines = [x for x in parts if "\n" in x and not x[-1].isspace()]
        self.later.update(zip(lines, self._plain([" " + x for x in lines])))
        plain = [x for x in parts if x and "\n" not in x and not x[-1].isspace()]
        self.later.update(zip(plain, self._lines([" " + x for x in plain])))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.later) > MEMORY or len(self.first) > MEMORY:
            self.first.clear()
            self.later.clear()
        get, out, found, missing, heads = self.later.get, [], [], set(), set()
        for text in texts:
            head, *own = text.split(" ")
            values = list(map(get, own))
            new = [x for x, value in zip(own, values) if value is None]
            missing.update(new)
            heads.add(head)
            found.append((text, head, own, None if new else values))
        self._learn(missing)
        heads.difference_update(self.first)
        self.first.update(zip(heads, self._plain(list(heads))))
        for text, head, own, values in found:
            if any(x in text for x in self.special):
                out.append(self._whole(text))
                continue
            try:
                if own and (not head or head[-1].isspace()):
                    raise TypeError("white space before a space")
                out.append(b"".join([self.first[head], *(values or map(get, own))]))
            except TypeError:  # a mark among the ids
                out.append(self._plain([text])[0])
        return out


_loaded: dict[tuple, object] = {}


def loaded(make: Callable, *args):
    """One encoder a worker; tasks on the same worker share what it remembers."""
    key = (make, *args)
    if key not in _loaded:
        _loaded[key] = make(*args)
    return _loaded[key]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for each row of ``docs``, by a sentencepiece model.

    Only lengths leave the workers. Batches hold about ``GROUP_BYTES`` of text; long texts are cut at safe boundaries
    (see :class:`PieceCounter`), so the counts are those of the whole texts. Null and empty texts have no bytes and
    no tokens; rows that repeat, null ids and ties stay as they are; an empty table gives an empty result. Further
    columns are not read.
    """

    def run(batches):
        counter = loaded(PieceCounter, model_path)
        for batch in batches:
            texts = utf8(batch.column(1))
            counts = [n for group in groups_by_bytes(texts) for n in counter.counts([texts[i].decode() for i in group])]
            sizes, counts = pa.array(map(len, texts), pa.int64()), np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts), pa.array(counts > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
