"""Arrow functions over XML text: one parse a document, structs out, Catalyst does the rest."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import trees


def arrow_function(schema: str, one: Callable, name: str, whole: bool = False) -> Callable[..., Column]:
    """A function of whole Arrow arrays that applies ``one`` to the values of each row; whole: ``one`` itself
    takes the arrays of one column in turn and gives arrays of as many values in all."""
    kind = T._parse_datatype_string(schema) if SparkSession.getActiveSession() else None

    def build() -> Callable[..., Column]:
        spark_type = kind or T._parse_datatype_string(schema)
        arrow_type = to_arrow_type(spark_type)

        def run(*columns: pa.Array) -> pa.Array:
            return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], arrow_type)

        if whole:
            one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
            return F.arrow_udf(one, spark_type)
        run.__name__ = name
        return F.arrow_udf(_typed(run), spark_type)

    made: list[Callable[..., Column]] = []

    def function() -> Callable[..., Column]:
        if not made:
            made.append(build())
        return made[0]

    def call(*columns: Column) -> Column:
        return function()(*columns)

    call.function = function  # type: ignore[attr-defined]
    return call


def _typed(run: Callable) -> Callable:
    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return run


FACTS = (
    "ok boolean, root string, skeleton array<struct<tag:string,attrs:array<struct<k:string,v:string>>>>, protected array<string>, prose string, "
    "lang string, titles array<string>, reuse boolean"
)


def _facts(xml: str | None) -> dict:
    root = trees.parse_body(xml)
    if root is None:
        return {"ok": False}
    return {
        "ok": True,
        "root": root.tag,
        "skeleton": [{"tag": e.tag, "attrs": [{"k": k, "v": v} for k, v in sorted(e.attrib.items())]} for e in root.iter()],
        "protected": trees.protected_texts(root),
        "prose": trees.prose(root, False),
        "lang": trees.prose(root, True),
        "titles": [trees.prose(e, True) for e in root.iter("title")],
        "reuse": trees.has_reuse(root),
    }


#: Facts of a document: see FACTS.
facts = arrow_function(f"struct<{','.join(p.strip().replace(' ', ':', 1) for p in FACTS.split(', '))}>", _facts, "xml_facts")


REPORT = (
    "struct<src_ok:boolean,hyp_ok:boolean,skeleton_ok:boolean,protected_changed:int,protected_total:int,src_prose:string,hyp_prose:string,ref_prose:string,"
    "src_lang:string,hyp_lang:string,src_titles:array<string>,hyp_titles:array<string>>"
)


def _report(source: str | None, hyp: str | None, ref: str | None) -> dict:
    a, b = trees.parse_body(source), trees.parse_body(hyp)
    out: dict = {"src_ok": a is not None, "hyp_ok": b is not None}
    if ref is not None:
        # a reference is often the answer itself
        c = b if ref == hyp else trees.parse_body(ref)
        out["ref_prose"] = None if c is None else trees.prose(c, False)
    if a is None or b is None:
        return out
    skeletons = ([(e.tag, sorted(e.attrib.items())) for e in r.iter()] for r in (a, b))
    x, y = trees.protected_texts(a), trees.protected_texts(b)
    changed = sum(p != q for p, q in zip(x, y, strict=True)) if len(x) == len(y) else max(len(x), len(y))
    out |= {"skeleton_ok": next(skeletons) == next(skeletons), "protected_changed": changed, "protected_total": len(x)}
    for side, r in (("src", a), ("hyp", b)):
        out |= {f"{side}_prose": trees.prose(r, False), f"{side}_lang": trees.prose(r, True), f"{side}_titles": [trees.prose(e, True) for e in r.iter("title")]}
    return out


#: All that a report needs of source, answer and reference, in one call.
report_facts = arrow_function(REPORT, _report, "xml_report")


def _nodes(xml: str | None) -> list[dict] | None:
    root = trees.parse_body(xml)
    if root is None:
        return None
    index = {id(e): i for i, e in enumerate(root.iter())}
    parent = {id(c): (index[id(p)], k) for p in root.iter() for k, c in enumerate(p)}
    return [
        {"i": index[id(e)], "parent": parent.get(id(e), (-1, 0))[0], "depth": d, "pos": parent.get(id(e), (-1, 0))[1], "tag": e.tag, "attrs": [{"k": k, "v": v} for k, v in e.attrib.items()], "text": e.text, "tail": e.tail}
        for e, d in trees.preorder(root)
    ]


#: The tree in preorder.
nodes = arrow_function("array<struct<i:int,parent:int,depth:int,pos:int,tag:string,attrs:array<struct<k:string,v:string>>,text:string,tail:string>>", _nodes, "xml_nodes")


def _segments(xml: str | None) -> list[dict]:
    root = trees.parse_body(xml)
    return [] if root is None else trees.segments(root)


#: Translatable blocks; length and word rules are left to the caller.
segments = arrow_function("array<struct<tag:string,xml:string,text:string>>", _segments, "xml_segments")


def _topic(xml: str | None) -> dict:
    root = trees.parse_body(xml)
    if root is None:
        return {"ok": False}
    return {"ok": True, "root": root.tag, "prose": trees.prose(root, False), "reuse": trees.has_reuse(root), "texts": [s["text"] for s in trees.segments(root)]}


#: What decides whether a document can be held out whole, in one parse.
topic = arrow_function("struct<ok:boolean,root:string,prose:string,reuse:boolean,texts:array<string>>", _topic, "xml_topic")


def _block_texts(xml: str | None) -> list[str]:
    root = trees.parse_body(xml)
    return [] if root is None else [trees.norm(trees.prose(e, False)) for e in root.iter() if e.tag in trees.SEGMENT_TAGS]


#: Normalised texts of all elements that could be segments.
block_texts = arrow_function("array<string>", _block_texts, "xml_block_texts")

DIFF = (
    "struct<src_ok:boolean,hyp_ok:boolean,reasons:array<string>,same:boolean,lcs:double,attr_recall:double,tag_mismatch:int,attr_value:int,child_order:int,"
    "src_text:string,hyp_text:string,hyp_all:string>"
)


def _diff(source: str | None, hyp: str | None) -> dict:
    a, b = trees.parse_document(source), trees.parse_document(hyp)
    out: dict = {"src_ok": a is not None, "hyp_ok": b is not None}
    if a is not None:
        out["src_text"] = trees.text_nodes(a)
    if b is not None:
        out |= {"hyp_text": trees.text_nodes(b), "hyp_all": trees.all_text(b)}
    if a is not None and b is not None:
        x, y = ([trees.signature(e) for e in r.iter()] for r in (a, b))
        reasons = trees.differences(a, b)
        tags, values, children = trees.structure_counts(a, b)
        out |= {
            "reasons": list(dict.fromkeys(reasons)),
            "same": x == y and not reasons,
            "lcs": round(trees.lcs_ratio(x, y), 4),
            "attr_recall": round(trees.attribute_recall(a, b), 4),
            "tag_mismatch": tags,
            "attr_value": values,
            "child_order": children,
        }
    return out


#: Structural comparison of source and hypothesis.
diff = arrow_function(DIFF, _diff, "xml_diff")

_SITE = "struct<index:int,mark:string,kind:string,ok:boolean,ambiguous:boolean,prev:string,excerpt:string,reason:string>"
ORACLE = (
    f"struct<src_ok:boolean,hyp_ok:boolean,error:string,reasons:array<string>,same:boolean,same_attributes:boolean,missing:array<struct<literal:string,need:int,have:int>>,"
    f"src_flows:array<struct<sites:array<{_SITE}>,quotes:int>>,hyp_flows:array<struct<sites:array<{_SITE}>,en_quotes:int,guillemets:int,nbsp:int>>>"
)


def _oracle(source: str | None, hyp: str | None) -> dict:
    a = trees.parse_document(source)
    b, error = trees.xml_only(hyp)
    out: dict = {"src_ok": a is not None, "hyp_ok": b is not None, "error": error}
    if a is None:
        return out | {"error": "source not well-formed"}
    if b is None:
        return out
    reasons = list(dict.fromkeys(trees.differences(a, b)))
    same = [trees.signature(e) for e in a.iter()] == [trees.signature(e) for e in b.iter()]
    return out | {
        "reasons": reasons,
        "same": same and not reasons,
        "same_attributes": same,
        "missing": trees.missing_literals(a, b),
        "src_flows": [{"sites": trees.marks(t, s), "quotes": trees.unshielded(t, s, '"“”«»')} for t, s in trees.flows(a)],
        "hyp_flows": [
            {"sites": trees.marks(t, s), "en_quotes": trees.unshielded(t, s, '"“”'), "guillemets": t.count("«") + t.count("»"), "nbsp": t.count(trees.NBSP)}
            for t, s in trees.flows(b)
        ],
    }


#: What the typography oracle needs of source and raw answer.
oracle_facts = arrow_function(ORACLE, _oracle, "xml_oracle")

fix_simple = arrow_function("string", lambda x: trees.fix_simple(x or ""), "fix_simple")
fix_aligned = arrow_function("string", trees.fix_aligned, "fix_aligned")
visible_text = arrow_function("string", lambda x: trees.visible_text(x or ""), "visible_text")
chrf = arrow_function("double", lambda h, r: None if h is None or r is None else trees.chrf(h, r), "chrf")
closed = arrow_function("boolean", lambda x: trees.closed(x or ""), "xml_closed")
flows = arrow_function("array<struct<text:string,spans:array<struct<s:int,e:int>>>>", lambda x: None if (r := trees.parse_document(x)) is None else [{"text": t, "spans": [{"s": a, "e": b} for a, b in s]} for t, s in trees.flows(r)], "inline_flows")


#: Characters whose places go back to Spark at once.
PLACES = 1 << 20


def _decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows of each array in pieces of PLACES characters, about."""
    kind = to_arrow_type(T.StructType().add("text", T.StringType()).add("spans", T.ArrayType(T.StructType().add("s", T.IntegerType()).add("e", T.IntegerType()))))
    at = kind.field("spans").type

    def packed(rows: list[tuple[str, np.ndarray, np.ndarray] | None]) -> pa.Array:
        none = np.empty(0, np.int32)
        texts, starts, ends = zip(*(r or (None, none, none) for r in rows), strict=True)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in starts])]).astype(np.int32)
        places = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (starts, ends)], fields=list(at.value_type))
        spans = pa.ListArray.from_arrays(pa.array(offsets), places, type=at)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), spans], fields=list(kind), mask=pa.array([t is None for t in texts]))

    for b in batches:
        rows, held = [], 0
        for raw in b:
            raw = raw.as_py()
            rows.append(None if raw is None else trees.decode_places(raw))
            held += len(raw or "")
            if held >= PLACES:
                yield packed(rows)
                rows, held = [], 0
        if rows or not len(b):
            yield packed(rows) if rows else pa.array([], kind)


#: Raw character data decoded, with the place of each character in the raw text; places leave in arrays of bounded size.
decode_mapped = arrow_function("struct<text:string,spans:array<struct<s:int,e:int>>>", _decoded, "decode_mapped", whole=True)

#: The oracle's reward of a source and an answer as one scalar, for callbacks and SQL.
gated_scalar = arrow_function("double", lambda s, h: trees.gated_scalar(s, h), "gated_scalar")

def validator(command: tuple[str, ...], catalog: str | None = None, timeout: float = 60.0) -> Callable[..., Column]:
    """A function of documents that runs an outside validator on each, the document on its standard input:
    struct(ok, n_errors, message). ``catalog`` names a catalog file that has to be there, on every node.

    Nothing is valid without its catalog or command; a validator that does not end counts as one error."""

    def one(document: str | None) -> dict:
        if catalog is not None and not os.path.isfile(catalog):
            return {"ok": False, "n_errors": 1, "message": f"missing catalog {catalog}"}
        env = os.environ | ({"XML_CATALOG_FILES": catalog} if catalog else {})
        try:
            p = subprocess.run(command, input=(document or "").encode(), capture_output=True, env=env, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired) as e:
            return {"ok": False, "n_errors": 1, "message": str(e)[:2000]}
        said = p.stderr.decode("utf-8", "replace").strip()
        n = sum(bool(_ERROR.search(line)) for line in said.splitlines())
        return {"ok": p.returncode == 0, "n_errors": max(n, int(p.returncode != 0)), "message": said[:2000]}

    return arrow_function("struct<ok:boolean,n_errors:int,message:string>", one, "xml_validator")


_ERROR = re.compile(r"validity error|parser error|error :|^error", re.I)

SQL_FUNCTIONS = ("chrf", "closed", "facts", "diff", "nodes", "segments", "flows", "fix_simple", "fix_aligned", "visible_text", "gated_scalar", "decode_mapped")


def register(spark: SparkSession, prefix: str = "xml_") -> list[str]:
    """Make the functions of this module callable from SQL."""
    for name in SQL_FUNCTIONS:
        spark.udf.register(prefix + name, globals()[name].function())
    return [prefix + name for name in SQL_FUNCTIONS]


__all__ = ["arrow_function", "block_texts", "chrf", "closed", "decode_mapped", "diff", "facts", "fix_aligned", "fix_simple", "flows", "gated_scalar", "nodes", "oracle_facts", "register", "report_facts", "segments", "topic", "validator", "visible_text"]
