"""Token counts with a shortcut for words that are one token."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from vektorloom.llm.common import map_rows

#: The mark that stands for a space in the pieces of the model (fixed value).
MARK = "▁"

#: Words whose counts one task remembers besides the proven ones.
MOST_WORDS = 250_000


def load_model(proto: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=proto)


def prove(proto: bytes) -> frozenset[str]:
    """Words (without their leading space) that the model encodes alone as one token.

    Also proves what the operator relies on: no piece of the vocabulary has a space after another character, so no
    merge reaches across the beginning of a word and the words of a text can be counted one by one. Raises otherwise.
    """
    model = load_model(proto)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        raise ValueError("pieces of this model reach across words")
    if model.encode("a b", out_type=str)[:1] != model.encode("a", out_type=str)[:1] or len(model.encode("  a")) != len(
        model.encode(MARK * 2 + "a")
    ):
        raise ValueError("this model treats spaces in another way")
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and p[1] != MARK]
    return frozenset(w for w, ids in zip(words, model.encode(words)) if len(ids) == 1)


class Counter(dict):
    """Tokens of a word with one space before it: 1 for proven words, else the model's merges."""

    def __init__(self, proto: bytes, proven: frozenset[str]):
        import re

        self.model, self.proven = load_model(proto), proven
        self.runs = re.compile(" +[^ ]*").findall
        self.update(dict.fromkeys(proven, 1))
        self.most = len(self) + MOST_WORDS

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = self[word] = len(self.model.encode(word, num_threads=1))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            # the model puts one space before the text; a run of spaces belongs to the word behind it
            return sum(self[run[1:]] if len(run) > 1 else 1 for run in self.runs(" " + text))
        return sum(map(self.__getitem__, text.split(" ")))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """One row per document: ``doc_id, n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have neither bytes nor tokens. The model file (half a megabyte) and the proven words are
    sent with the tasks. Other columns are not read; repeated rows are counted again; an empty table gives no rows.
    """
    proto = Path(model_path).read_bytes()
    proven = prove(proto)

    def make():
        counter = Counter(proto, proven)

        def work(rows):
            texts = [text or "" for text in rows["text"]]
            n = [counter.count(text) for text in texts]
            return {
                "doc_id": rows["doc_id"],
                "n_bytes": [len(text.encode()) for text in texts],
                "n_tokens": n,
                "over_limit": [x > limit for x in n],
            }

        return work

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
