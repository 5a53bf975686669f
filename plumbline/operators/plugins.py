"""Where a model or a SQL user plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from plumbline.operators.parsing import pack_sentences


def map_model(df: DataFrame, call: Callable[[dict], dict], schema: str, valid: Callable[[dict], str | None] | None = None) -> DataFrame:
    """Call a model on every row; a row that fails stays, with the reason in ``error``.

    ``schema`` names the columns the model fills; ``valid`` returns a complaint or None.
    """
    inputs = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    names = [part.strip().split()[0].strip("`") for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for record in b.to_dict("records"):
                try:
                    got = call(record)
                    error = valid(got) if valid else None
                except Exception as e:
                    got, error = {}, f"{type(e).__name__}: {e}"
                rows.append([None if error else got.get(n) for n in names] + [error])
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=names + ["error"])], axis=1)

    return df.mapInPandas(run, f"{inputs}, {schema}, error string")


def split_spoken(text: str) -> list[str]:
    import re

    marked = re.sub(r"""([.!?][.!?"'’)\]]*)(\s+|$)""", "\\1\u0001", text)
    return [s for s in (p.strip() for p in marked.split("\u0001")) if s]


@udtf(returnType="sentence_no: int, sentence: string")
class Sentences:
    def eval(self, text: str):
        yield from enumerate(split_spoken(text or ""))


@udtf(returnType="chunk_no: int, chunk: string")
class Chunks:
    def eval(self, text: str, limit: int):
        yield from enumerate(pack_sentences(split_spoken(text or ""), text or "", limit))


@udtf(returnType="ref_no: int, raw: string")
class ReferenceEntries:
    def eval(self, body: str):
        import re

        found = re.findall(r"(?s)\[\d+\]\s*(.*?)(?=\n?\[\d+\]|$)", body or "")
        parts = found if len(found) >= 3 else [p for p in re.split(r"\n\s*\n", body or "")]
        clean = [re.sub(r"\s+", " ", p).strip() for p in parts]
        yield from enumerate(c for c in clean if len(c) > (20 if len(found) >= 3 else 30))


def register(spark: SparkSession) -> None:
    """Make the table functions callable from SQL."""
    spark.udtf.register("sentences", Sentences)
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("reference_entries", ReferenceEntries)
