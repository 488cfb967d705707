"""Topologies kept as JSON: chains of residues of atoms, and bonds."""

from __future__ import annotations

import json as _json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOM = "STRUCT<index: BIGINT, name: STRING, element: STRING>"
RESIDUE = f"STRUCT<index: BIGINT, name: STRING, resSeq: BIGINT, segmentID: STRING, atoms: ARRAY<{ATOM}>>"
SCHEMA = f"STRUCT<chains: ARRAY<STRUCT<index: BIGINT, residues: ARRAY<{RESIDUE}>>>, bonds: ARRAY<ARRAY<BIGINT>>>"


def parsed(json: Column) -> Column:
    return F.from_json(json, SCHEMA)


def chains(df: DataFrame, json: str = "topology", keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.explode(parsed(F.col(json)).chains).alias("c")).select(*keep, F.col("c.index").alias("chain_idx"), F.size("c.residues").alias("n_residues"))


def residues(df: DataFrame, json: str = "topology", keep: tuple[str, ...] = ()) -> DataFrame:
    c = df.select(*keep, F.explode(parsed(F.col(json)).chains).alias("c"))
    return c.select(*keep, F.col("c.index").alias("chain_idx"), F.explode("c.residues").alias("r")).select(*keep, "chain_idx", F.col("r.index").alias("residue_idx"), F.col("r.name").alias("residue_name"), F.col("r.resSeq").alias("res_seq"), F.col("r.segmentID").alias("segment_id"), "r.atoms")


def atoms(df: DataFrame, json: str = "topology", keep: tuple[str, ...] = ()) -> DataFrame:
    r = residues(df, json, keep)
    return r.select(*keep, "chain_idx", "residue_idx", F.explode("atoms").alias("a")).select(*keep, "chain_idx", "residue_idx", F.col("a.index").alias("atom_idx"), F.col("a.name").alias("atom_name"), F.col("a.element").alias("element"))


def atom_count(json: Column) -> Column:
    return F.aggregate(parsed(json).chains, F.lit(0).cast("long"), lambda n, c: n + F.aggregate(c.residues, F.lit(0).cast("long"), lambda m, r: m + F.size(r.atoms)))


def subset(df: DataFrame, indexes: list[int], json: str = "topology") -> DataFrame:
    """(atoms, bonds) of a subset in the order asked for: atoms renumbered from 0, bonds with both ends inside."""
    if len(set(indexes)) != len(indexes):
        raise ValueError("an atom is asked for twice")
    new = F.create_map(*(F.lit(x) for i, k in enumerate(indexes) for x in (k, i))) if indexes else F.create_map(F.lit(-1), F.lit(-1))
    rows = atoms(df, json).withColumn("new_idx", new[F.col("atom_idx").cast("int")]).filter("new_idx is not null").select("new_idx", "chain_idx", "residue_idx", "atom_name", "element")
    bonds = df.select(F.explode(parsed(F.col(json)).bonds).alias("b")).select(new[F.col("b")[0].cast("int")].alias("i"), new[F.col("b")[1].cast("int")].alias("j")).na.drop()
    return rows, bonds


def subset_json(topology: str, indexes: list[int]) -> str:
    """The topology of some atoms, as JSON: atoms are renumbered in the order asked for, residues and chains in the order
    in which they first occur, and bonds stay whose ends are both inside. One small document, on the driver."""
    if len(set(indexes)) != len(indexes):
        raise ValueError("an atom is asked for twice")
    top = _json.loads(topology)
    where = {a["index"]: (c, r, a) for c in top["chains"] for r in c["residues"] for a in r["atoms"]}
    if missing := [i for i in indexes if i not in where]:
        raise ValueError(f"no atoms {missing}")
    chains_: dict[int, dict] = {}
    residues_: dict[int, dict] = {}
    for new, i in enumerate(indexes):
        c, r, a = where[i]
        chain = chains_.setdefault(c["index"], {"index": len(chains_), "residues": []})
        if r["index"] not in residues_:
            residues_[r["index"]] = {**r, "index": len(residues_), "atoms": []}
            chain["residues"].append(residues_[r["index"]])
        residues_[r["index"]]["atoms"].append({**a, "index": new})
    to = {i: new for new, i in enumerate(indexes)}
    bonds = [[to[a], to[b]] for a, b in top.get("bonds", []) if a in to and b in to]
    return _json.dumps({"chains": list(chains_.values()), "bonds": bonds})


def from_atoms(rows: list[tuple[int, int, str, int, str, str]], bonds: list[tuple[int, int]]) -> str:
    """A topology's JSON from atoms in order: (chain, residue, residue name, residue number, atom name, element)."""
    out: dict[int, dict] = {}
    for i, (chain, residue, name, number, atom, element) in enumerate(rows):
        c = out.setdefault(chain, {"index": chain, "residues": []})
        if not c["residues"] or c["residues"][-1]["index"] != residue:
            c["residues"].append({"index": residue, "name": name, "resSeq": number, "segmentID": "", "atoms": []})
        c["residues"][-1]["atoms"].append({"index": i, "name": atom, "element": element})
    return _json.dumps({"chains": list(out.values()), "bonds": [list(b) for b in bonds]})
