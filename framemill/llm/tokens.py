"""Token counts with files of public tokenizers; the file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from framemill.session import spread

#: Where the vocabulary files lie on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def counter(path: str = TOKENIZER) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts; special-token strings in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def with_token_counts(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of rows (doc_id, source, text): whole texts, null and empty ones have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            texts = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "source": pdf["source"], "n_tokens": count(texts)})

    return spread(rows.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")
