"""Language identification with hyperdimensional profiles.

Every letter class has a random +1/-1 vector.  The vector of a letter triple is
the product of the three letters' vectors, shifted by two, one and no places, so
that it depends on order; a text's profile is the sum over its triples, and a
language's prototype the sum over its training texts.  A text belongs to the
language whose prototype has the largest cosine with its profile.

Texts without a letter, empty and null texts are ``und`` with score 0; bytes that
are not UTF-8 count as marks; texts of any length are read whole; of equal cosines
the first language by code point wins; repeated rows and null keys get equal
results; with nothing to learn from every text is ``und``; an empty table gives an
empty result.  Only doc_id, text and lang are read, so extra columns of any name
are no matter; the results' names are fixed.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm import text as T
from rowmill.llm.samples import held_out

DIM, CLASSES, TOP = 1024, 128, 0x323B0
TRIPLES = CLASSES**3
_cache: dict = {}


def letter_classes() -> np.ndarray:
    """Class by code point: 0 for what is no letter, 1-26 for a-z, 27-58 for the
    lower-case letters of Latin-1, the other classes shared by hash."""
    if "classes" not in _cache:
        table = np.zeros(TOP + 1, np.uint8)
        for c in range(TOP):
            if 0xD800 <= c < 0xE000 or unicodedata.category(chr(c))[0] != "L":
                continue
            low = chr(c).lower()
            k = ord(low[0])
            table[c] = k - 96 if 97 <= k <= 122 else k - 0xDF + 27 if 0xDF <= k <= 0xFE else 59 + k % (CLASSES - 59)
        _cache["classes"] = table
    return _cache["classes"]


def letter_vectors(dim: int = DIM) -> np.ndarray:
    if dim not in _cache:
        bits = np.unpackbits(T.seeds(CLASSES * dim // 64, 11).view(np.uint8)).reshape(CLASSES, dim)
        _cache[dim] = bits.astype(np.int8) * 2 - 1
    return _cache[dim]


def triple_vectors(ids: np.ndarray, dim: int = DIM) -> np.ndarray:
    v = letter_vectors(dim)
    two, one = np.roll(v, 2, 1), np.roll(v, 1, 1)
    return two[ids // (CLASSES * CLASSES)] * one[ids // CLASSES % CLASSES] * v[ids % CLASSES]


def triples(view: np.ndarray, offs: np.ndarray):
    """(triple id, row) for every letter triple, a word's ends counting as class 0; and rows with a letter."""
    view, offs = T.clean_utf8(view, offs)
    n = len(offs) - 1
    head = T.HEAD[view]
    at = np.concatenate(([0], np.cumsum(head)))[offs]
    code = np.frombuffer(view.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kind = letter_classes()[np.minimum(code, TOP)].astype(np.int64)
    # one gap before and after every text; runs of gaps become one
    grown = np.zeros(len(kind) + 2 * n, np.int64)
    where = np.arange(len(kind)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))
    grown[where] = kind
    row = np.repeat(np.arange(n), np.diff(at) + 2)
    keep = np.ones(len(grown), bool)
    keep[1:] = (grown[1:] > 0) | (grown[:-1] > 0) | (row[1:] != row[:-1])
    grown, row = grown[keep], row[keep]
    lettered = T.per_row(row[grown > 0], n) > 0
    if len(grown) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    t = (grown[:-2] * CLASSES + grown[1:-1]) * CLASSES + grown[2:]
    ok = (row[:-2] == row[2:]) & (t > 0)
    return t[ok], row[:-2][ok], lettered


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """The learned languages, sorted, and their prototypes, from all rows of
    ``docs`` with a language.  Triples are counted on the executors; what comes
    back has at most languages * CLASSES**3 rows, and far fewer in practice."""

    def count(batches):
        for b in batches:
            langs, code = np.unique(np.array(b.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for lo, view, offs in T.views(b.column("text"), 16 * T.CHUNK):
                t, row, _ = triples(view, offs)
                key, n = np.unique(code[lo + row].astype(np.int64) * TRIPLES + t, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs[key // TRIPLES].astype(object), pa.string()), pa.array((key % TRIPLES).astype(np.int32)), pa.array(n)], ["lang", "t", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    got = rows.mapInArrow(count, "lang string, t int, n long").groupBy("lang", "t").agg(F.sum("n").alias("n")).toArrow()
    lang_of, t, n = np.array(got.column("lang").to_pylist(), object), got.column("t").to_numpy(), got.column("n").to_numpy().astype(np.float64)
    langs = sorted(set(lang_of))
    proto = np.zeros((len(langs), dim))
    for i, name in enumerate(langs):
        own = np.flatnonzero(lang_of == name)
        for k in range(0, len(own), 8192):
            j = own[k : k + 8192]
            proto[i] += n[j] @ triple_vectors(t[j], dim).astype(np.float64)
    norm = np.linalg.norm(proto, axis=1, keepdims=True)
    return langs, (proto / np.maximum(norm, 1e-12)).astype(np.float32)


def identifier(langs: list[str], proto: np.ndarray):
    """An Arrow UDF text -> struct(lang, score); score is the cosine, 0 at least."""
    dim = proto.shape[1] if len(langs) else DIM

    @F.arrow_udf("struct<lang: string, score: double>")
    def identify(col: pa.Array) -> pa.Array:
        lang, score = np.full(len(col), "und", object), np.zeros(len(col))
        for lo, view, offs in T.views(col, T.CHUNK):
            t, row, lettered = triples(view, offs)
            n = len(offs) - 1
            if not langs or not len(t):
                continue
            ids, slot = np.unique(t, return_inverse=True)
            profile = np.zeros((n, dim), np.float32)
            for k in range(0, len(ids), 4096):  # a bounded block of triples at a time
                own = (slot >= k) & (slot < k + 4096)
                width = min(4096, len(ids) - k)
                counts = np.bincount(row[own] * width + slot[own] - k, minlength=n * width).reshape(n, width).astype(np.float32)
                profile += counts @ triple_vectors(ids[k : k + width], dim).astype(np.float32)
            cos = profile @ proto.T / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
            best = cos.argmax(1)
            own = lo + np.flatnonzero(lettered)
            lang[own] = np.array(langs, object)[best[lettered]]
            score[own] = np.clip(cos[np.arange(n), best], 0, 1)[lettered]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return identify.asNondeterministic()


def languages(docs: DataFrame, folds: int = 4, out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score; prototypes come from the rows outside fold ``out_fold``."""
    out = held_out(F.col("doc_id"), folds, out_fold)
    identify = identifier(*prototypes(docs.where(~out)))
    return docs.select("doc_id", out.alias("held_out"), identify("text").alias("_l")).select("doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))
