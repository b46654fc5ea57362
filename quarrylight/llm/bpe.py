"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be
merged over, whatever surrounds it.  Between two such bytes a cut is certain, so
a word falls into fragments that are encoded independently and concatenated.
Fragments repeat far more than texts do; each worker keeps a bounded memory of
white-space separated chunks it has met.

Defined results: a null or empty text has no ids, an empty id text and an empty
decoded text.  Repeated rows give repeated results.  Columns other than the id
and the text are dropped, so clashing names cannot occur.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import ship_package

#: Chunks that a worker remembers, twice (a young and an old generation), and the
#: length up to which it remembers one: what it holds is bounded in bytes.
REMEMBERED, LONGEST = 1 << 18, 48
#: White space of the tokenizer's patterns. str.split() also cuts at 1C to 1F.
_GAPS = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_GAPS = re.compile(r"[\x1c-\x1f]")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Memory(dict):
    """chunk -> value, computed when first asked for; bounded by two generations of
    chunks of bounded length."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.compute(key)
        value = self.old.get(key) or self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ForcedBoundaryCodec:
    """Encodes and decodes as the tokenizers file at ``path`` does.

    Reads word-level BPE files: NFC, lower case, white space dropped, a pattern
    that splits words, byte-level alphabet, an end-of-word suffix, no decoder."""

    def __init__(self, path: str, *, cut: bool = True):
        from tokenizers import Tokenizer

        #: words of up to LONGEST signs are cut, too; the ids are the same
        self.cut = cut
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ends = Tokenizer.from_str(json.dumps(spec))
        self.last = self.ends.model
        model["end_of_word_suffix"] = None
        self.rest_of = Tokenizer.from_str(json.dumps(spec))
        self.inner = self.rest_of.model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.strings = [""] * (1 + max(*model["vocab"].values(), *self.special.values(), 0))
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            self.strings[i] = token
        self.joined = set()
        for token in model["vocab"]:
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.joined.update(map("".join, zip(body, body[1:], strict=False)))
        self.chunks = Memory(self._chunk)

    def fragments(self, word: str) -> list[str]:
        """A word in the byte alphabet, cut wherever no token can reach across."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.alphabet)
        if not self.cut and len(word) <= LONGEST or self.joined.issuperset(map(add, word, word[1:])):
            ids = [t.id for t in self.last.tokenize(word)]
        else:
            *inner, last = self.fragments(word)
            ids = [t.id for part in inner for t in self.inner.tokenize(part)]
            ids += [t.id for t in self.last.tokenize(last)]
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return self._word(low) if low == chunk else self.chunks[low]
            words = self.pattern.findall(low)
            return b"".join(map(self.chunks.__getitem__, words)) if len(words) > 1 else b"".join(map(self._word, words))
        chunk = unicodedata.normalize("NFC", chunk)
        # lower() turns a final capital sigma into another letter than the library does
        low = "".join(map(str.lower, chunk)) if "\u03a3" in chunk else chunk.lower()
        return self._word(low) if low.isalpha() else b"".join(map(self._word, self.pattern.findall(low)))

    def _plain(self, text: str) -> bytes:
        chunks = _GAPS.split(text) if _ODD_GAPS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.special_cut and "<|" in text and len(parts := self.special_cut.split(text)) > 1:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts)
        return self._plain(text)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids, joined by spaces: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, bool], ForcedBoundaryCodec] = {}


def codec(path: str, *, cut: bool = True) -> ForcedBoundaryCodec:
    """The codec of this worker process for a file."""
    if (path, cut) not in _codecs:
        _codecs[path, cut] = ForcedBoundaryCodec(path, cut=cut)
    return _codecs[path, cut]


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, as_text: bool = False) -> DataFrame:
    """-> id, ``ids`` (binary, little-endian unsigned 32-bit), and if asked for ``decoded``
    and ``id_text`` (decimal ids, joined by one space).

    One pass over the rows; nothing is shuffled."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [source.schema["doc_id"], T.StructField("ids", T.BinaryType())]
    if decode:
        fields.append(T.StructField("decoded", T.StringType()))
    if as_text:
        fields.append(T.StructField("id_text", T.StringType()))
    rows = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([own.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
                if as_text:
                    columns.append(pa.array([" ".join(map(str, np.frombuffer(x, "<u4").tolist())) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))
