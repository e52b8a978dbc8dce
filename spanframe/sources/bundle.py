"""Model bundles: a manifest, tensors and files, checked on the driver before anything is sent; and reports on what is wrong."""

from __future__ import annotations

import json
import struct
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.regex_tokenizer import is_safe_path

FORMAT, REPORT = 1, 1
_TYPES = {"F32": "<f4", "U64": "<u8"}
AREAS = ("manifest", "file", "component", "graph_node", "attribute", "tensor", "tokenizer", "tokenizer_feature", "language")


@dataclass(frozen=True)
class Limits:
    manifest: int = 16 << 20
    weights: int = 1 << 30
    tokenizer: int = 64 << 20
    state: int = 256 << 20
    components: int = 128
    nodes: int = 32768
    tensors: int = 131072
    rank: int = 8


class BundleError(Exception):
    """What a report shows: a code, an area, where, and why."""

    def __init__(self, code: str, area: str, message: str, component: str | None = None, node: int | None = None, item: str | None = None):
        super().__init__(message)
        self.code, self.area, self.component, self.node, self.item = code, area, component, node, item

    def row(self) -> tuple:
        return self.code, self.area, self.component, self.node, self.item, str(self)


def read_limited(path: Path, most: int) -> bytes:
    """A file of at most so many bytes: its size first, then one byte more than allowed, as it may grow meanwhile."""
    if not path.is_file():
        raise BundleError("missing_file", "file", f"{path.name} is missing", item=path.name)
    if path.stat().st_size > most:
        raise BundleError("bundle_limit_exceeded", "file", f"{path.name} is over {most} bytes", item=path.name)
    with path.open("rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise BundleError("bundle_limit_exceeded", "file", f"{path.name} is over {most} bytes", item=path.name)
    return data


_TENSOR = {"key": str, "dtype": str, "shape": list}
_NODE = {"index": int, "name": str, "dims": dict, "refs": dict, "params": dict}
_COMPONENT = {"name": str, "factory": str, "kind": str}
KINDS, TOKENIZERS = ("trainable", "rule_based"), ("regex", "delarocha", "sudachi")


def _shaped(x, fields: dict, what: str) -> dict:
    """x, an object that has these fields with these types."""
    if not isinstance(x, dict):
        raise BundleError("invalid_manifest_json", "manifest", f"{what} isn't an object")
    for name, kind in fields.items():
        if not isinstance(x.get(name), kind) or kind is int and isinstance(x[name], bool):
            raise BundleError("invalid_manifest_json", "manifest", f"{what} has no {name}", item=name)
    return x


def _list(x: dict, name: str, what: str) -> list:
    if not isinstance(x.get(name, []), list):
        raise BundleError("invalid_manifest_json", "manifest", f"{name} of {what} isn't a list", item=name)
    return x.get(name, [])


def parse_manifest(text: str | bytes, limits: Limits = Limits()) -> dict:
    """The manifest, with its optional fields filled in. Components are under pipeline, in the order in which they run."""
    try:
        m = json.loads(text)
    except ValueError as e:
        raise BundleError("invalid_manifest_json", "manifest", str(e)) from e
    _shaped(m, {"format_version": int}, "the manifest")
    if m["format_version"] != FORMAT:
        raise BundleError("unsupported_bundle_format", "manifest", f"format {m['format_version']} isn't {FORMAT}")
    _shaped(m, {"source": dict, "runtime": dict, "tokenizer": dict, "pipeline": list}, "the manifest")
    _shaped(m["source"], dict.fromkeys(("spacy_version", "model_name", "model_version", "lang"), str), "source")
    _shaped(m["runtime"], {"min_runtime_version": str, "requires_python": bool}, "runtime")
    _shaped(m["tokenizer"], {"kind": str, "path": str}, "tokenizer")
    if m["tokenizer"]["kind"] not in TOKENIZERS:
        raise BundleError("invalid_manifest_json", "tokenizer", f"no tokenizer is called {m['tokenizer']['kind']}", item=m["tokenizer"]["kind"])
    if m["runtime"]["requires_python"]:
        raise BundleError("python_required", "manifest", "the bundle needs a foreign runtime")
    _safe(m["tokenizer"]["path"])
    _limit(len(m["pipeline"]), limits.components, "components")
    seen, tensors = set(), 0
    for c in m["pipeline"]:
        _shaped(c, _COMPONENT, "a component")
        name = c["name"]
        if not name or not c["factory"]:
            raise BundleError("invalid_component", "component", "a component has no name or no factory", component=name or None)
        if c["kind"] not in KINDS:
            raise BundleError("invalid_manifest_json", "component", f"no component is {c['kind']}", component=name)
        if name in seen:
            raise BundleError("invalid_component", "component", f"{name} comes twice", component=name)
        seen.add(name)
        for field in ("nodes", "labels", "moves"):
            c[field] = _list(c, field, name)
        c.setdefault("settings", {}), c.setdefault("state_path", None), c.setdefault("root_node", None)
        _limit(len(c["nodes"]), limits.nodes, "nodes")
        index = Counter(_shaped(x, _NODE, f"a node of {name}")["index"] for x in c["nodes"])
        if twice := [k for k, n in index.items() if n > 1]:
            raise BundleError("duplicate_graph_node", "graph_node", f"node {twice[0]} comes twice", name, twice[0])
        if c["kind"] == "trainable" and c["root_node"] not in index:
            raise BundleError("missing_graph_node", "graph_node", "the root is missing", name, c["root_node"])
        for x in c["nodes"]:
            x["children"] = _list(x, "children", f"node {x['index']}")
            x.setdefault("attrs", {}), x.setdefault("omitted_attrs", [])
            for child in x["children"]:
                if child not in index:
                    raise BundleError("missing_graph_node", "graph_node", f"child {child} is missing", name, child)
            tensors += len(x["params"])
            for t in x["params"].values():
                _limit(len(_shaped(t, _TENSOR, f"a tensor of {name}")["shape"]), limits.rank, "rank")
        _limit(tensors, limits.tensors, "tensors")
        if c["state_path"] is not None:
            _safe(c["state_path"], name)
    if m.get("vectors") is not None:
        for t in _shaped(m["vectors"], {"data": dict, "keys": dict, "rows": dict}, "vectors").values():
            tensors += 1
            _limit(len(_shaped(t, _TENSOR, "vectors")["shape"]), limits.rank, "rank")
        _limit(tensors, limits.tensors, "tensors")
    return m


def _safe(path: str, component: str | None = None) -> None:
    if not is_safe_path(path):
        raise BundleError("unsafe_bundle_path", "file", f"{path!r} leaves the bundle", component, item=path)


def _limit(n: int, most: int, what: str) -> None:
    if n > most:
        raise BundleError("bundle_limit_exceeded", "manifest", f"{n} {what} are over {most}", item=what)


def tensors_of(m: dict):
    """(component, node, parameter, tensor) of all that a manifest names; the vectors' component is 'vectors'."""
    for c in m["pipeline"]:
        for x in c["nodes"]:
            for name, t in x["params"].items():
                yield c["name"], x["index"], name, t
    for name, t in (m.get("vectors") or {}).items():
        yield "vectors", None, name, t


def read_tensors(data: bytes) -> dict[str, np.ndarray]:
    """The F32 and U64 tensors of a safetensors file."""
    try:
        n = struct.unpack_from("<Q", data)[0]
        head, body = json.loads(data[8:8 + n]), data[8 + n:]
    except (struct.error, ValueError) as e:
        raise BundleError("invalid_weights", "file", str(e)) from e
    out = {}
    for name, t in head.items():
        if name == "__metadata__":
            continue
        if t["dtype"] not in _TYPES:
            raise BundleError("tensor_dtype", "tensor", f"{name} has the type {t['dtype']}", item=name)
        a, b = t["data_offsets"]
        kind = np.dtype(_TYPES[t["dtype"]])
        if b > len(body) or (b - a) != kind.itemsize * int(np.prod(t["shape"], dtype=np.int64)):
            raise BundleError("invalid_tensor_data", "tensor", f"{name} has {b - a} bytes", item=name)
        out[name] = np.frombuffer(body[a:b], kind).reshape(t["shape"])
    return out


def write_tensors(tensors: dict[str, np.ndarray]) -> bytes:
    head, at = {}, 0
    for name, t in tensors.items():
        kind = "F32" if t.dtype == np.float32 else "U64"
        head[name] = {"dtype": kind, "shape": list(t.shape), "data_offsets": [at, at + t.nbytes]}
        at += t.nbytes
    raw = json.dumps(head).encode()
    return struct.pack("<Q", len(raw)) + raw + b"".join(t.astype(t.dtype.newbyteorder("<")).tobytes() for t in tensors.values())


def cross_check(manifest: dict, tensors: dict[str, np.ndarray]) -> None:
    """Each tensor of the manifest is there once, with its shape and type."""
    seen: set[str] = set()
    for component, node, _, t in tensors_of(manifest):
        key, where = t["key"], (component, node)
        if key in seen:
            raise BundleError("duplicate_tensor", "tensor", f"{key} is used twice", *where, key)
        seen.add(key)
        if key not in tensors:
            raise BundleError("missing_tensor", "tensor", f"{key} is missing", *where, key)
        if list(tensors[key].shape) != list(t["shape"]):
            raise BundleError("tensor_shape", "tensor", f"{key} is {list(tensors[key].shape)}, not {t['shape']}", *where, key)
        if t["dtype"] != ("F32" if tensors[key].dtype == np.float32 else "U64"):
            raise BundleError("tensor_dtype", "tensor", f"{key} isn't {t['dtype']}", *where, key)


@dataclass
class Bundle:
    manifest: dict
    tensors: dict[str, np.ndarray]
    tokenizer: bytes | None

    def tensor(self, key: str, kind: str = "F32") -> np.ndarray:
        t = self.tensors.get(key)
        if t is None:
            raise BundleError("missing_tensor", "tensor", f"{key} is missing", item=key)
        if t.dtype != np.dtype(_TYPES[kind]):
            raise BundleError("tensor_dtype", "tensor", f"{key} isn't {kind}", item=key)
        return t


def load(root: str | Path, limits: Limits = Limits()) -> Bundle:
    root = Path(root)
    m = parse_manifest(read_limited(root / "manifest.json", limits.manifest), limits)
    tensors = read_tensors(read_limited(root / "weights.safetensors", limits.weights))
    tokenizer = read_limited(root / m["tokenizer"]["path"], limits.tokenizer)
    cross_check(m, tensors)
    for c in m["pipeline"]:
        if c["state_path"] is not None:
            read_limited(root / c["state_path"], limits.state)
    return Bundle(m, tensors, tokenizer)


def save(root: str | Path, manifest: dict, tensors: dict[str, np.ndarray], tokenizer: dict) -> None:
    """Write a bundle that load() takes."""
    root = Path(root)
    root.mkdir(parents=True, exist_ok=True)
    (root / "manifest.json").write_text(json.dumps(manifest))
    (root / "weights.safetensors").write_bytes(write_tensors(tensors))
    (root / manifest["tokenizer"]["path"]).write_text(json.dumps(tokenizer))


DIAGNOSTICS = "array<struct<code:string,area:string,component:string,node:int,item:string,message:string>>"


def inspect(spark, root: str | Path, limits: Limits = Limits()) -> DataFrame:
    """One row: report_version, compatible, language, diagnostics. It never fails; what is wrong is a diagnostic: a pipeline is built, but not run."""
    from spanframe.plans.pipeline import Pipeline

    language, wrong = None, []
    try:
        b = load(root, limits)
        language = b.manifest["source"]["lang"]
        Pipeline.load(b)
    except BundleError as e:
        wrong = [e.row()]
    except OSError as e:
        wrong = [("bundle_io", "file", None, None, None, str(e))]
    return spark.createDataFrame([(REPORT, not wrong, language, wrong)], f"report_version int, compatible boolean, language string, diagnostics {DIAGNOSTICS}")


def tensors_per_component(spark, manifest: dict) -> DataFrame:
    rows = [(c, node, k) for c, node, k, _ in tensors_of(manifest)]
    return spark.createDataFrame(rows, "component string, node int, param string").groupBy("component").agg(F.count("*").alias("tensors"))
