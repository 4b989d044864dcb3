"""Python code that runs inside Spark tasks.

Only what has no built-in expression: depth-unbounded walks over a document,
one file per row.  Each function maps an
iterator of Arrow batches and keeps no state across documents.
The module is pickled by value, so executors need no installed package.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 2000


def _batches(rows, **types):
    """Group a generator of tuples into Arrow batches of bounded length."""
    import itertools

    import pyarrow as pa

    schema = pa.schema([(name, pa.type_for_alias(t) if isinstance(t, str) else t) for name, t in types.items()])
    rows = iter(rows)
    while held := list(itertools.islice(rows, ROWS)):
        columns = [pa.array(column, field.type) for column, field in zip(zip(*held), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _pairs(batch, *names):
    return zip(*[batch.column(name).to_pylist() for name in names])


def _keyed_batches(batches, rows_of, **types):
    """Per input batch: run ``rows_of`` over its ``key, text`` and keep the key's type."""
    for batch in batches:
        yield from _batches(rows_of(_pairs(batch, "key", "text")), key=batch.schema.field("key").type, **types)


# ---------------------------------------------------------------- document walks
def _scalar(value):
    """Text and JSON type of a leaf; text is as written, without quotes."""
    if value is None:
        return None, "null"
    if isinstance(value, str):
        return value, "string"
    return json.dumps(value), "boolean" if isinstance(value, bool) else "number"


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _leaves(value, path, exact):
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from _leaves(inner, f"{path}_{name}" if path is not None else name, f"{exact}.{name}")
    elif isinstance(value, list):
        for pos, inner in enumerate(value):
            yield from _leaves(inner, f"{path}_{pos}" if path is not None else str(pos), f"{exact}[{pos}]")
    else:
        yield (path or "", exact, *_scalar(value))


LEAF_FIELDS = "path string, exact_path string, value string, type string"


def leaf_rows(batches):
    """``(key, text)`` to one row per leaf."""

    def rows(pairs):
        for key, text in pairs:
            document = _parsed(text)
            if document is not None:
                for leaf in _leaves(document, None, "$"):
                    yield (key, *leaf)

    yield from _keyed_batches(batches, rows, path="string", exact_path="string", value="string", type="string")


def _keyed(value):
    """Key/value pairs at any depth, parents first; a list inside a list is not entered."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield name, inner
            for member in inner if isinstance(inner, list) else (inner,):
                yield from _keyed(member) if isinstance(member, dict) else ()


NODE_FIELDS = "ord long, name string, value string, type string"


def node_rows(names):
    """``(key, text)`` to one row per value stored under one of ``names``."""
    wanted = frozenset(names)

    def rows(pairs):
        for key, text in pairs:
            for order, (name, value) in enumerate(_keyed(_parsed(text))):
                if name in wanted:
                    if isinstance(value, (dict, list)):
                        shown = json.dumps(value), "object" if isinstance(value, dict) else "array"
                    else:
                        shown = _scalar(value)
                    yield (key, order, name, *shown)

    def run(batches):
        yield from _keyed_batches(batches, rows, ord="int64", name="string", value="string", type="string")

    return run


# ---------------------------------------------------------------- one file per document
def write_files(outdir):
    """``(_id_x, _file, raw)`` to pretty-printed files below a shared folder of any file system."""

    def rows(batches):
        import uuid

        from pyarrow import fs

        uri = f"file://{outdir[5:]}" if outdir.startswith("file:") and not outdir.startswith("file://") else outdir
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for number, name, raw in _pairs(batch, "_id_x", "_file", "raw"):
                target = f"{root}/{os.path.basename(name)}"
                partial = f"{root}/.{uuid.uuid4().hex}.part"
                document = _parsed(raw)
                with store.open_output_stream(partial) as out:
                    out.write((raw if document is None else json.dumps(document, indent=4)).encode())
                store.move(partial, target)  # a retried task leaves no half-written file
                yield number, name, target

    def run(batches):
        yield from _batches(rows(batches), _id_x="int64", _file="string", path="string")

    return run


def indented(indent):
    def run(texts):
        return texts.map(lambda text: None if text is None else json.dumps(json.loads(text), indent=indent))

    return run
