"""Mentions from texts: sentences, a pluggable tagger, tag sequences to (software, version), original spacing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.functions import text as T

Tagged = list[tuple[str, str]]
#: Makes a function that tags a list of sentences; called once in a worker, so a model is loaded once there.
Tagger = Callable[[], Callable[[list[str]], list[Tagged]]]
TAGS = ("O", "B-software", "I-software", "B-version", "I-version", "PAD")


def sentences(df: DataFrame, text: str = "text", keep: list[str] | None = None, most: int = 512) -> DataFrame:
    """Rows (keep..., sentence_no, sentence): white space collapsed, split at '. ', cut to ``most`` characters. A null text has none."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    parts = df.filter(F.col(text).isNotNull()).select(*keep, F.posexplode(T.split_sentences(T.collapse_space(F.col(text)))).alias("sentence_no", "sentence"))
    return parts.withColumn("sentence", T.truncated(F.col("sentence"), most))


def dictionary_tagger(names: set[str], versions: str = r"v?\d+(\.\d+)*") -> Tagger:
    """Tags known names, and numbers right after one; words are the parts between white space."""

    def make():
        import re

        number = re.compile(versions)

        def tag(batch: list[str]) -> list[Tagged]:
            out = []
            for s in batch:
                row, after = [], False
                for w in s.split():
                    bare = w.strip(".,;:()")
                    if bare in names:
                        row.append((bare, "B-software"))
                        after = True
                    elif after and number.fullmatch(bare):
                        row.append((bare, "B-version"))
                        after = False
                    else:
                        row.append((w, "O"))
                        after = False
                out.append(row)
            return out

        return tag

    return make


def glued(pieces: Tagged) -> Tagged:
    """Word pieces as words: a piece that starts with ## goes on with the one before, which gives the tag."""
    out: Tagged = []
    for token, tag in pieces:
        if token.startswith("##") and out:
            out[-1] = (out[-1][0] + token[2:], out[-1][1])
        else:
            out.append((token, tag))
    return out


def collapse(tagged: Tagged, legacy: bool = False) -> list[tuple[str, str]]:
    """(software, version) of a tagged sentence. A version belongs to the name before it; a new name after a version
    starts a new mention. ``legacy`` carries a version over to that mention."""
    out: list[tuple[str, str]] = []
    name, version = "", ""
    for token, tag in tagged:
        if tag == "O":
            if name:
                out.append((name, version))
            name, version = "", ""
        elif tag.endswith("-software"):
            if version:
                out.append((name, version))
                name = token
                version = version if legacy else ""
            else:
                name = f"{name} {token}".strip()
        elif tag.endswith("-version"):
            version = f"{version} {token}".strip()
    if name:
        out.append((name, version))
    return out


def mentions(sents: DataFrame, tagger: Tagger, sentence: str = "sentence", legacy: bool = False, batch: int = 256) -> DataFrame:
    """One row a mention: the sentence's columns, and software, version. Sentences go to the tagger in batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = tagger()
        for b in batches:
            texts = [s or "" for s in b.column(sentence).to_pylist()]
            found = [collapse(glued(t), legacy) for at in range(0, len(texts), batch) for t in tag(texts[at : at + batch])]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            said = [pa.array([m[k] for f in found for m in f], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in b.columns], *said], names=[*b.schema.names, "software", "version"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sents.schema)
    return sents.mapInArrow(work, fields + ", software string, version string")


def detokenize(df: DataFrame, text: str = "text", columns: tuple[str, ...] = ("software", "version")) -> DataFrame:
    """The named columns in the spacing of the text."""
    return df.withColumns({c: T.detokenized(c, text) for c in columns})
