"""Text formats: FASTA, Newick/NEXUS, PDB and mmCIF, as Python parsers and as DataFrames of parsed rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FASTA_SCHEMA = "path string, ordinal int, name string, description string, sequence string"
NODE_SCHEMA = "path string, node_id int, parent_id int, name string, length double, tag string, depth int, tip_index int"
ATOM_SCHEMA = "path string, chain string, number int, insertion string, residue string, aa string, ordinal int"


def fasta_records(text: str) -> Iterator[tuple[str, str, str]]:
    """(name, description, sequence) of each record; ';' lines are comments, letters become upper case."""
    name = description = None
    parts: list[str] = []
    for line in text.removeprefix("﻿").splitlines():
        line = line.strip()
        if not line or line[0] == ";":
            continue
        if line[0] == ">":
            if name is not None:
                yield name, description, "".join(parts).upper()
            head = line[1:].strip().split(None, 1)
            if not head:
                raise ValueError("a FASTA record has no name")
            name, description, parts = head[0], head[1] if len(head) > 1 else "", []
        elif name is None:
            raise ValueError("FASTA text begins without a header")
        else:
            parts.append(re.sub(r"\s+", "", line))
    if name is not None:
        yield name, description, "".join(parts).upper()


def checked_alignment(text: str, least_taxa: int = 2, codons: bool = False) -> list[tuple[str, str]]:
    """(name, sequence) of an alignment: unique names, equal lengths, U read as T, whole codons if asked for."""
    rows = [(n, s.replace("U", "T") if codons else s) for n, _, s in fasta_records(text)]
    if len(rows) < least_taxa:
        raise ValueError(f"an alignment needs {least_taxa} sequences or more")
    if len({n for n, _ in rows}) < len(rows):
        raise ValueError("names must be unique")
    lengths = {len(s) for _, s in rows}
    if 0 in lengths:
        raise ValueError("a sequence is empty")
    if len(lengths) > 1:
        raise ValueError("sequences differ in length")
    if codons and lengths.pop() % 3:
        raise ValueError("the length is no multiple of three")
    return rows


@dataclass
class Node:
    name: str = ""
    length: float | None = None
    tag: str | None = None
    children: list[Node] = field(default_factory=list)


def newick_text(text: str) -> str:
    """The first tree of a NEXUS file, or the text itself; comments go, but for tags in braces."""
    if text.lstrip().upper().startswith("#NEXUS"):
        m = re.search(r"(?is)\btree\b[^=]*=\s*(?:\[[^\]]*\]\s*)*(.*?;)", text)
        if not m:
            raise ValueError("there is no tree in the NEXUS text")
        text = m[1]
    return re.sub(r"\[[^\]]*\]", "", text).strip()


def parse_newick(text: str) -> Node:
    text = newick_text(text)
    tokens = re.findall(r"'(?:[^']|'')*'|[(),:;]|\{[^}]*\}|[^\s(),:;{}']+", text)
    at = 0

    def label(node: Node) -> None:
        nonlocal at
        while at < len(tokens) and tokens[at] not in "(),;":
            t = tokens[at]
            if t == ":":
                at += 1
                node.length = float(tokens[at])
            elif t[0] == "{":
                node.tag = t[1:-1]
            else:
                node.name = t[1:-1].replace("''", "'") if t[0] == "'" else t
            at += 1

    root = Node()
    stack = [root]
    if not tokens or tokens[0] != "(":
        raise ValueError("a tree begins with a parenthesis")
    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t == "(":
            node = Node()
            stack[-1].children.append(node)
            stack.append(node)
            label(node)
        elif t == ",":
            stack.pop()
            if not stack:
                raise ValueError("parentheses don't match")
            node = Node()
            stack[-1].children.append(node)
            stack.append(node)
            label(node)
        elif t == ")":
            stack.pop()
            if not stack:
                raise ValueError("parentheses don't match")
            label(stack[-1])
        elif t == ";":
            break
    if len(stack) != 1:
        raise ValueError("parentheses don't match")
    return root


def nodes_of(root: Node) -> list[tuple[int, int | None, str, float, str | None, int, int | None]]:
    """(node_id, parent_id, name, length, tag, depth, tip_index) in preorder; tips are numbered from 0."""
    out, tips, todo = [], 0, [(root, None, 0)]
    while todo:
        node, parent, depth = todo.pop()
        i = len(out)
        tip = None if node.children else tips
        tips += not node.children
        out.append((i, parent, node.name, node.length or 0.0, node.tag, depth, tip))
        todo += [(c, i, depth + 1) for c in reversed(node.children)]
    return out


def quote(name: str) -> str:
    return name if re.fullmatch(r"[^\s(),:;{}'\[\]]+", name) else "'" + name.replace("'", "''") + "'"


def write_newick(root: Node, lengths: bool = True, tags: bool = True) -> str:
    """Text of a tree of any depth, without recursion."""
    done: dict[int, str] = {}
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo += [(node, True), *((c, False) for c in node.children)]
            continue
        text = "(" + ",".join(done.pop(id(c)) for c in node.children) + ")" if node.children else ""
        text += quote(node.name) if node.name else ""
        text += f"{{{node.tag}}}" if tags and node.tag is not None else ""
        text += f":{node.length:.10g}" if lengths and node.length is not None else ""
        done[id(node)] = text
    return done[id(root)] + ";"


#: Three-letter codes of the amino acids.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M",
    "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U", "PYL": "O",
}


def pdb_residues(text: str) -> list[tuple[str, int, str, str, str]]:
    """(chain, number, insertion, residue, letter) of the first model, one row for each residue."""
    seen: dict[tuple[str, int, str], tuple] = {}
    for line in text.splitlines():
        if line.startswith("ENDMDL"):
            break
        if line[:6] in ("ATOM  ", "HETATM") and line[16:17] in (" ", "A", "1") and (aa := RESIDUES.get(line[17:20].strip())):
            key = (line[21:22].strip() or "_", int(line[22:26]), line[26:27].strip())
            seen.setdefault(key, (*key, line[17:20].strip(), aa))
    return list(seen.values())


def cif_tokens(text: str) -> Iterator[str]:
    """Values of a CIF text in turn: bare, quoted or multi-line."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.startswith(";"):
            held = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                held.append(more)
            yield "\n".join(held)
            continue
        for m in re.finditer(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(#.*)|(\S+)", line):
            if m[3] is not None:
                break
            yield next(g for g in (m[1], m[2], m[4]) if g is not None)


def cif_residues(text: str) -> list[tuple[str, int, str, str, str]]:
    """The same rows from the atom_site loop of an mmCIF text."""
    tokens = list(cif_tokens(text))
    seen: dict[tuple[str, int, str], tuple] = {}
    at = 0
    while at < len(tokens):
        if tokens[at] != "loop_" or at + 1 >= len(tokens) or not tokens[at + 1].startswith("_atom_site."):
            at += 1
            continue
        at += 1
        names = []
        while at < len(tokens) and tokens[at].startswith("_"):
            names.append(tokens[at].partition(".")[2])
            at += 1
        column = {n: k for k, n in enumerate(names)}
        get = lambda row, *keys: next((row[column[k]] for k in keys if k in column and row[column[k]] not in ".?"), "")
        while at + len(names) <= len(tokens) and not re.match(r"loop_$|_|data_|#", tokens[at]):
            row = tokens[at : at + len(names)]
            at += len(names)
            if get(row, "pdbx_PDB_model_num") not in ("", "1") or get(row, "label_alt_id") not in ("", "A", "1"):
                continue
            residue = get(row, "auth_comp_id", "label_comp_id")
            number = get(row, "auth_seq_id", "label_seq_id")
            if (aa := RESIDUES.get(residue)) and re.fullmatch(r"-?\d+", number):
                key = (get(row, "auth_asym_id", "label_asym_id") or "_", int(number), get(row, "pdbx_PDB_ins_code"))
                seen.setdefault(key, (*key, residue, aa))
    return list(seen.values())


def _files(texts: DataFrame) -> DataFrame:
    return texts.select("path", "text")


def read_fasta(texts: DataFrame) -> DataFrame:
    """(path, text) -> one row for each record."""
    import pandas as pd

    def parse(batches):
        for batch in batches:
            yield pd.DataFrame([(p, k, *r) for p, t in zip(batch["path"], batch["text"], strict=True) for k, r in enumerate(fasta_records(t))], columns=["path", "ordinal", "name", "description", "sequence"])

    return _files(texts).mapInPandas(parse, FASTA_SCHEMA)


def read_newick(texts: DataFrame) -> DataFrame:
    """(path, text) -> one row for each node."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            rows = [(p, *n) for p, t in zip(batch["path"], batch["text"], strict=True) for n in nodes_of(parse_newick(t))]
            out = pd.DataFrame(rows, columns=["path", "node_id", "parent_id", "name", "length", "tag", "depth", "tip_index"])
            yield out.astype({"parent_id": "Int32", "tip_index": "Int32"})

    return _files(texts).mapInPandas(parse, NODE_SCHEMA)


def read_structures(texts: DataFrame) -> DataFrame:
    """(path, text) -> one row for each residue, PDB or mmCIF by content."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for p, t in zip(batch["path"], batch["text"], strict=True):
                found = cif_residues(t) if re.search(r"(?m)^(data_|_atom_site\.|loop_)", t) else pdb_residues(t)
                rows += [(p, *r, k) for k, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "chain", "number", "insertion", "residue", "aa", "ordinal"])

    return _files(texts).mapInPandas(parse, ATOM_SCHEMA)


def text_files(spark, *paths: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.decode("content", "UTF-8").alias("text"))


def register_fasta(spark) -> None:
    """``spark.read.format("fasta").load(path)``: a Python data source with a partition for each file."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class FilePartition(InputPartition):
        def __init__(self, path: str):
            self.path = path

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self):
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
            info = store.get_file_info(root)
            files = [root] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
            return [FilePartition(f) for f in files]

        def read(self, partition):
            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
            with store.open_input_stream(partition.path) as f:
                text = f.read().decode("utf-8")
            for k, (name, description, sequence) in enumerate(fasta_records(text)):
                yield partition.path, k, name, description, sequence

    class Fasta(DataSource):
        @classmethod
        def name(cls):
            return "fasta"

        def schema(self):
            return FASTA_SCHEMA

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Fasta)
