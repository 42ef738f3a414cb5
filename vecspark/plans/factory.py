"""Indexes from short descriptions, such as ``PCA32,IVF64,PQ16x4,RFlat``.

Parts are separated by commas: transforms, a coarse quantizer, the codes, a refinement. The grammar's names are fixed
values of the format:

* transforms ``PCA[W][R]n L2norm RRn ITQn OPQm_d Padn``
* coarse ``IVFn`` (also ``IVFn_HNSWm`` and ``IVFn_NSGr``: the lists are found exactly), ``IMI2xb``, ``IVFn(RCQmxb)``
* codes ``Flat SQ4 SQ6 SQ8 SQfp16 PQm[xb][np] PQm[xb]+r[xb] PQmx4fs[r] RQmxb LSQmxb PRQpxmxb PLSQpxmxb LSH[r][t] ZnLatticepxr2_b``,
  ``Residualn`` (two layers: a coarse quantizer and a product codec), ``FlatDedup``, ``ITQ,SH`` and ``RowMin`` wrappers
* graphs ``HNSWm NSGr`` with codes behind them (``HNSW32,SQ8``), in place of a coarse quantizer: see ``graph_index``
* wrappers ``RFlat Refine(codes) IDMap IDMap2``
* binary, by ``binary_index``: ``BFlat BIVFn BHashb BHashtxb BHNSWm``
"""

from __future__ import annotations

import re

from vecspark.functions.vectors import Metric
from vecspark.plans import codecs as C
from vecspark.plans import transforms as X
from vecspark.plans.binary import BinaryIndex
from vecspark.plans.graph_index import GraphIndex
from vecspark.plans.index import VectorIndex


def split_parts(text: str) -> list[str]:
    """At commas that no bracket holds."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]


def transform_of(text: str, d: int):
    """(transform, its output's dimensions), or None."""
    if m := re.fullmatch(r"PCA(W?)(R?)(\d+)", text):
        return X.PCA(d=int(m[3]), power=-0.5 if m[1] else 0.0, rotate=bool(m[2])), int(m[3])
    if text == "L2norm":
        return X.Normalize(), d
    if m := re.fullmatch(r"RR(\d*)", text):
        return X.Rotation(d=int(m[1] or d)), int(m[1] or d)
    if m := re.fullmatch(r"ITQ(\d*)", text):
        return X.ITQ(d=int(m[1] or d)), int(m[1] or d)
    if m := re.fullmatch(r"OPQ(\d+)(?:_(\d+))?", text):
        return X.OPQ(m=int(m[1]), d=int(m[2] or d)), int(m[2] or d)
    if m := re.fullmatch(r"Pad(\d+)", text):
        return X.Remap.padded(d, int(m[1]), uniform=False), int(m[1])
    return None


def codec_of(text: str, d: int):
    """The codec of a code part, or None."""
    if text in ("Flat", "FlatDedup"):
        return C.Flat()
    if m := re.fullmatch(r"SQ(4|6|8|fp16|8_direct)", text):
        return C.Scalar({"4": "4bit", "6": "6bit", "8": "8bit", "fp16": "fp16", "8_direct": "8bit_direct"}[m[1]])
    if m := re.fullmatch(r"PQ(\d+)(?:x(\d+))?(?:fsr?|np|fs_\d+)?", text):
        return C.Product(int(m[1]), int(m[2] or 8))
    if m := re.fullmatch(r"PQ(\d+)(?:x(\d+))?\+(\d+)(?:x(\d+))?", text):
        return C.TwoLevel(C.Product(int(m[1]), int(m[2] or 8)), C.Product(int(m[3]), int(m[4] or 8)))
    if m := re.fullmatch(r"R?C?(RQ|LSQ)(\d+)x(\d+)(?:fsr?)?", text):
        return (C.Residual if m[1] == "RQ" else C.LocalSearch)(int(m[2]), int(m[3]))
    if m := re.fullmatch(r"P(RQ|LSQ)(\d+)x(\d+)x(\d+)(?:fsr?)?", text):
        return C.Split(int(m[2]), C.Residual if m[1] == "RQ" else C.LocalSearch, int(m[3]), int(m[4]))
    if m := re.fullmatch(r"LSH(r?)(t?)", text):
        return C.Signs(bool(m[2]))
    if m := re.fullmatch(r"ZnLattice(\d+)x(\d+)(?:_(\d+))?", text):
        return C.Lattice(int(m[1]), int(m[2]), int(m[3] or 4))
    if m := re.fullmatch(r"SH(?:([\d.]+))?", text):
        return C.Spectral(float(m[1] or 1.0))
    if m := re.fullmatch(r"RowMin(16)?\((.+)\)", text):
        return C.RowRange(codec_of(m[2], d), bool(m[1]))
    return None


def binary_index(d: int, description: str) -> BinaryIndex:
    """An untrained index of vectors of ``d`` bits."""
    if m := re.fullmatch(r"BFlat|B(IVF|HNSW|Hash)(?:(\d+)x)?(\d+)", description):
        return BinaryIndex(d, m[1] or "Flat", int(m[3] or 0), int(m[2] or 1))
    raise ValueError(f"no such index: {description}")


def vector_index(d: int, description: str, metric: Metric = Metric.L2) -> VectorIndex | GraphIndex:
    """An untrained index of vectors of ``d`` dimensions."""
    index, own, done = VectorIndex(metric=metric), d, False
    parts = split_parts(description)
    graphs = [m for m in (re.fullmatch(r"(HNSW|NSG)(\d+)", p) for p in parts) if m]
    if graphs:
        if metric != Metric.L2 or len(graphs) > 1:
            raise ValueError(f"{description}: one graph, by L2")
        inner = vector_index(d, ",".join([p for p in parts if p != graphs[0][0]] or ["Flat"]), metric)
        if inner.nlist or inner.refine is not None:
            raise ValueError(f"{description}: a graph takes transforms and codes")
        return GraphIndex(graphs[0][1].lower(), int(graphs[0][2]), inner)
    while parts and parts[-1] in ("IDMap", "IDMap2"):
        parts.pop()  # ids are a column of every table
    if parts and (m := re.fullmatch(r"RFlat|Refine\((.+)\)", parts[-1])):
        index.refine, index.k_factor = (codec_of(m[1], d) if m[1] else C.Flat()), 4.0
        parts.pop()
    for part in parts:
        if found := transform_of(part, own):
            if done:
                raise ValueError(f"{part} stands behind the codes")
            index.chain.append(found[0])
            own = found[1]
        elif m := re.fullmatch(r"IVF(\d+)(?:_(?:HNSW|NSG)\d+)?", part):
            index.nlist = int(m[1])
        elif m := re.fullmatch(r"IVF(\d+)\((?:R?CQ|RCQ|RQ)(\d+)x(\d+)\)", part):
            index.coarse, index.nlist = C.Residual(int(m[2]), int(m[3])), 1 << int(m[2]) * int(m[3])
        elif m := re.fullmatch(r"IMI(\d+)x(\d+)", part):
            index.coarse, index.nlist = MultiIndex(int(m[1]), int(m[2])), 1 << int(m[1]) * int(m[2])
        elif m := re.fullmatch(r"Residual(?:(\d+)x(\d+)|(\d+))", part):
            if m[1]:
                index.coarse, index.nlist = MultiIndex(int(m[1]), int(m[2])), 1 << int(m[1]) * int(m[2])
            else:
                index.nlist = int(m[3])
            index.nprobe = index.nlist
        elif codec := codec_of(part, own):
            if part.startswith("LSHr") or part.startswith("LSHrt"):
                index.chain.append(X.Rotation(d=own))
            index.codec, index.dedup, done = codec, part == "FlatDedup", True
        else:
            raise ValueError(f"no such part: {part}")
    return index


class MultiIndex(C.Product):
    """A coarse quantizer of all combinations of the parts' codewords."""

    def all_sums(self):
        import numpy as np

        out = self.book[0]
        for b in self.book[1:]:
            out = np.hstack([np.repeat(out, len(b), 0), np.tile(b, (len(out), 1))])
        return out
