"""From a bundle to what runs: the graph of nodes becomes a Model's weights by name, settings become rules; and the way back.

All of this is the driver's work on what is small; the model is broadcast when it is used.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

from spanframe.functions import kernels as K
from spanframe.operators import encoder as N
from spanframe.operators.patterns import Pattern, Step, check_constraint, quantifier
from spanframe.operators.regex_tokenizer import Config
from spanframe.operators.ruler import PHRASE_ATTRIBUTES, Ruler
from spanframe.sources.bundle import FORMAT, Bundle, BundleError, save

LISTENERS = ("tok2vec-listener", "transformer-listener")


def wrong(c: dict, message: str, node: dict | None = None, item: str | None = None) -> BundleError:
    return BundleError("invalid_component" if node is None else "invalid_graph_node", "component" if node is None else "graph_node", message, c["name"], node and node["index"], item)


def _named(c: dict, name: str) -> list[dict]:
    return [x for x in c["nodes"] if x["name"] == name]


def _node(c: dict, index: int | None) -> dict:
    found = [x for x in c["nodes"] if x["index"] == index]
    if not found:
        raise BundleError("missing_graph_node", "graph_node", f"node {index} is missing", c["name"], index)
    return found[0]


def _dim(c: dict, x: dict, name: str) -> int:
    n = x["dims"].get(name)
    if not isinstance(n, int) or n < 1:
        raise wrong(c, f"no dimension {name}", x, name)
    return n


def _param(b: Bundle, c: dict, x: dict, name: str, shape: tuple[int, ...]) -> np.ndarray:
    if name not in x["params"]:
        raise wrong(c, f"no parameter {name}", x, name)
    t = b.tensor(x["params"][name]["key"])
    if t.shape != shape:
        raise BundleError("tensor_shape", "tensor", f"{name} is {list(t.shape)}, not {list(shape)}", c["name"], x["index"], x["params"][name]["key"])
    return t


def _layer(b: Bundle, c: dict, maxout: dict, name: str) -> dict[str, np.ndarray]:
    """A maxout and the normalization beside it."""
    out, pieces, inputs = (_dim(c, maxout, k) for k in ("nO", "nP", "nI"))
    both = [x for x in _named(c, "maxout>>layernorm") if x["children"][:1] == [maxout["index"]] and len(x["children"]) > 1]
    if not both:
        raise wrong(c, "a maxout has no normalization", maxout)
    norm = _node(c, both[0]["children"][1])
    return {f"{name}.W": _param(b, c, maxout, "W", (out, pieces, inputs)), f"{name}.b": _param(b, c, maxout, "b", (out, pieces)), f"{name}.gain": _param(b, c, norm, "G", (out,)), f"{name}.shift": _param(b, c, norm, "b", (out,))}


def _window(x: dict, width: int) -> int | None:
    try:
        return K.window_of(x["dims"].get("nI") or 0, width) if x["dims"].get("nO") == width else None
    except ValueError:
        return None


def _static(b: Bundle, c: dict, x: dict):
    v, out, width = b.manifest.get("vectors"), _dim(c, x, "nO"), _dim(c, x, "nM")
    if v is None:
        raise wrong(c, "the bundle has no word vectors", x)
    data, keys, rows = b.tensor(v["data"]["key"]), b.tensor(v["keys"]["key"], "U64"), b.tensor(v["rows"]["key"], "U64")
    if data.ndim != 2 or data.shape[1] != width or keys.ndim != 1 or keys.shape != rows.shape or (len(rows) and rows.max() >= len(data)):
        raise wrong(c, "word vectors of another shape", x)
    order = np.argsort(keys, kind="stable")
    return keys[order], rows[order].astype(np.int64), data, _param(b, c, x, "W", (out, width))


def encoder(b: Bundle, c: dict) -> dict:
    """The arguments of a Model that encodes as the component does."""
    marks = _named(c, "extract_features")
    columns = marks[0]["attrs"].get("columns") if marks else None
    if not isinstance(columns, list) or not 1 <= len(columns) <= 16 or any(x not in N.COLUMNS for x in columns):
        raise BundleError("unsupported_tokenizer_feature" if isinstance(columns, list) else "invalid_component", "attribute", f"feature columns {columns}", c["name"], item="columns")
    tables = sorted(_named(c, "hashembed"), key=lambda x: x["attrs"].get("column", -1))
    if [x["attrs"].get("column") for x in tables] != list(range(len(columns))):
        raise wrong(c, "there isn't one table for each feature column")
    weights, seeds, width = {}, [], _dim(c, tables[0], "nO")
    for k, x in enumerate(tables):
        seed = x["attrs"].get("seed")
        if not isinstance(seed, int) or not 0 <= seed < 1 << 32:
            raise wrong(c, "no seed", x, "seed")
        seeds.append(seed)
        weights[f"embed.{k}"] = _param(b, c, x, "E", (_dim(c, x, "nV"), _dim(c, x, "nO")))
    words = _named(c, "static_vectors")
    static = _static(b, c, words[0]) if words else None
    inputs = width * len(columns) + (len(static[3]) if static else 0)
    first = [x for x in _named(c, "maxout") if x["dims"].get("nI") == inputs]
    if not first:
        raise wrong(c, f"no maxout takes the {inputs} features")
    weights |= _layer(b, c, first[0], "mix")
    width = _dim(c, first[0], "nO")
    roots = [x for x in c["nodes"] if isinstance(x["attrs"].get("pad"), int) and "residual(expand_window" in x["name"]]
    if not roots:
        raise wrong(c, "no padded convolutions")
    below, todo = set(), [roots[0]["index"]]
    while todo:
        k = todo.pop()
        if k not in below:
            below.add(k)
            todo += _node(c, k)["children"]
    layers = [x for x in _named(c, "maxout") if _window(x, width) is not None]
    layers = [x for x in layers if x["index"] in below] or layers
    if not layers:
        raise wrong(c, "no convolution layers")
    windows = []
    for k, x in enumerate(sorted(layers, key=lambda x: x["index"])):
        windows.append(_window(x, width))
        weights |= _layer(b, c, x, f"conv.{k}")
    if roots[0]["attrs"]["pad"] < sum(windows):
        raise wrong(c, "fewer rows of padding than the convolutions look at", roots[0], "pad")
    return {"weights": weights, "seeds": seeds, "columns": columns, "windows": windows, "pad": roots[0]["attrs"]["pad"], "static": static}


def transitions(b: Bundle, c: dict, name: str) -> dict[str, np.ndarray]:
    """The weights of a parser or a recognizer."""
    root = _node(c, c["root_node"])
    lower, upper, below = (_node(c, root["refs"].get(k)) for k in ("lower", "upper", "tok2vec"))
    project = [x for x in (_node(c, k) for k in reversed(below["children"])) if x["name"] == "linear"]
    if not project or lower["name"] != "precomputable_affine":
        raise wrong(c, "the graph has no projection or no lower layer")
    inputs, outputs, features, pieces = (_dim(c, lower, k) for k in ("nI", "nO", "nF", "nP"))
    w = _linear(b, c, project[0], f"{name}.project")
    w |= {f"{name}.lower.W": _param(b, c, lower, "W", (features, outputs, pieces, inputs)), f"{name}.lower.b": _param(b, c, lower, "b", (outputs, pieces)), f"{name}.lower.pad": _param(b, c, lower, "pad", (1, features, outputs, pieces))[0]}
    classes = outputs
    if upper["name"] != "noop":
        w |= _linear(b, c, upper, f"{name}.upper")
        classes = len(w[f"{name}.upper.W"])
    if len(c["moves"]) != classes:
        raise wrong(c, f"{classes} scores but {len(c['moves'])} moves")
    return w


def _linear(b: Bundle, c: dict, x: dict, name: str, kind: str = "linear") -> dict[str, np.ndarray]:
    if x["name"] != kind:
        raise wrong(c, f"{x['name']} isn't {kind}", x)
    out, inputs = _dim(c, x, "nO"), _dim(c, x, "nI")
    return {f"{name}.W": _param(b, c, x, "W", (out, inputs)), f"{name}.b": _param(b, c, x, "b", (out,))}


def classifier(b: Bundle, c: dict, name: str) -> dict[str, np.ndarray]:
    nodes = _named(c, "softmax")
    if not nodes:
        raise wrong(c, "no softmax")
    w = _linear(b, c, nodes[0], name, "softmax")
    if len(c["labels"]) != len(w[f"{name}.W"]):
        raise wrong(c, f"{len(w[f'{name}.W'])} outputs but {len(c['labels'])} labels")
    return w


def upstream(b: Bundle, heads: list[dict], always: tuple[str, ...] = ("parser", "tagger")) -> tuple[dict | None, list[dict]]:
    """The encoder component that the heads listen to, and the heads that have their own."""
    name, asked, own = None, None, []
    for c in heads:
        if not any(x["name"] in LISTENERS for x in c["nodes"]) and c["factory"] not in always:
            own.append(c)
            continue
        up = c["settings"].get("tok2vec_upstream", "tok2vec")
        if not isinstance(up, str) or not up:
            raise BundleError("invalid_upstream_tok2vec", "component", f"the encoder {up!r}", c["name"])
        if name not in (None, up):
            raise BundleError("conflicting_upstream_tok2vec", "component", f"{name} and {up} are both asked for", c["name"])
        name, asked = up, c["name"]
    if name is None:
        return None, own
    found = [c for c in b.manifest["pipeline"] if c["name"] == name]
    if not found:
        raise BundleError("missing_upstream_tok2vec", "component", f"there is no encoder {name}", asked)
    return found[0], own


def model(b: Bundle, heads: dict[str, dict]) -> N.Model:
    """heads: the components of tag, senter, parse and ner, as far as there are any."""
    up, alone = upstream(b, list(heads.values()))
    weights, more = {}, {}
    try:
        for head, c in heads.items():
            if head in ("tag", "senter"):
                weights |= classifier(b, c, "tagger" if head == "tag" else "senter")
            else:
                weights |= transitions(b, c, "parser" if head == "parse" else "ner")
        own = {head: N.Model(**encoder(b, c)) for head, c in heads.items() if c in alone}
        base = encoder(b, up) if up else {"weights": {}, "seeds": []}
        more = {"tags": heads["tag"]["labels"] if "tag" in heads else [], "parser": heads["parse"]["moves"] if "parse" in heads else [], "entities": heads["ner"]["moves"] if "ner" in heads else []}
        labels = heads["ner"]["labels"] if "ner" in heads else []
        return N.Model(**{**base, "weights": base["weights"] | weights}, **more, own=own, labels=labels)
    except ValueError as e:
        raise BundleError("invalid_component", "component", str(e)) from e


def setting(c: dict, name: str, kind: type, default=None):
    value = c["settings"].get(name, default)
    if not isinstance(value, kind):
        raise BundleError("invalid_setting", "attribute", f"{name} is {value!r}", c["name"], item=name)
    return value


def ruler(c: dict) -> Ruler:
    """An entity ruler's patterns: phrases as ids of their words, and tokens' constraints."""
    attr = setting(c, "phrase_matcher_attr", str)
    if attr not in PHRASE_ATTRIBUTES:
        raise BundleError("invalid_setting", "attribute", f"phrases can't be compared by {attr}", c["name"], item="phrase_matcher_attr")
    made = []
    stops = setting(c, "stop_word_ids", list, [])
    try:
        for p in [*setting(c, "patterns", list), *setting(c, "token_patterns", list, [])]:
            label, ident = p.get("label"), p.get("id", "")
            if not isinstance(label, str) or not label or not isinstance(ident, str):
                raise ValueError("a pattern needs a label, and its id is a string")
            if "tokens" in p:
                if not p["tokens"]:
                    raise ValueError(f"the pattern of {label} is empty")
                for t in p["tokens"]:
                    for x in t["constraints"]:
                        check_constraint(x)
                made.append(Pattern(label, ident, steps=tuple(Step({"CONSTRAINTS": t["constraints"]}, *quantifier(t["op"])) for t in p["tokens"])))
            else:
                ids = p.get("token_ids")
                if not isinstance(ids, list) or not ids or any(not isinstance(x, int) or isinstance(x, bool) or x < 0 for x in ids):
                    raise ValueError(f"the pattern of {label} has no token_ids")
                made.append(Pattern(label, ident, phrase=tuple(map(str, ids)), by_id=True))
        if any(not isinstance(x, int) for x in stops):
            raise ValueError("stop_word_ids aren't ids")
    except (ValueError, KeyError, TypeError) as e:
        raise BundleError("invalid_setting", "attribute", str(e), c["name"], item="patterns") from e
    return Ruler(made, setting(c, "overwrite_ents", bool), attr, tuple(stops))


def config(b: Bundle) -> Config:
    try:
        return Config.load(b.tokenizer)
    except (ValueError, KeyError, TypeError) as e:
        raise BundleError("invalid_tokenizer_configuration", "tokenizer", str(e)) from e


def save_model(root: str | Path, m: N.Model, heads: tuple[str, ...], lang: str = "en", tokenizer: Config = Config(), rules: list[dict] = ()) -> None:
    """Write a model and components of rules (name, factory, settings, and before: the head that it comes before) as a bundle."""
    tensors, pipeline = {}, []

    def node(index, name, params=None, children=(), refs=None, dims=None, **attrs):
        made = {}
        for k, t in (params or {}).items():
            key = f"{len(tensors)}"
            tensors[key] = np.ascontiguousarray(t, np.float32)
            made[k] = {"key": key, "dtype": "F32", "shape": list(t.shape)}
        return {"index": index, "name": name, "children": list(children), "dims": dims or {}, "refs": refs or {}, "params": made, "attrs": attrs}

    def component(name, factory, nodes, root=0, **more):
        pipeline.append({"name": name, "factory": factory, "kind": "trainable" if nodes else "rule_based", "root_node": root if nodes else None, "settings": {}, "nodes": nodes, "state_path": None, "labels": [], "moves": []} | more)

    w, nodes = m.w, [node(1, "extract_features", columns=list(m.columns))]
    nodes += [node(2 + k, "hashembed", {"E": w[f"embed.{k}"]}, dims={"nV": len(w[f"embed.{k}"]), "nO": w[f"embed.{k}"].shape[1]}, seed=s, column=k) for k, s in enumerate(m.seeds)]
    if m.static:
        nodes.append(node(60, "static_vectors", {"W": m.static[3]}, dims={"nO": len(m.static[3]), "nM": m.static[3].shape[1]}))
    for k, name in enumerate(["mix", *(f"conv.{k}" for k in range(m.depth))]):
        out, pieces, inputs = w[f"{name}.W"].shape
        at = 100 + 3 * k
        nodes += [node(at, "maxout", {"W": w[f"{name}.W"], "b": w[f"{name}.b"]}, dims={"nO": out, "nP": pieces, "nI": inputs}), node(at + 1, "layernorm", {"G": w[f"{name}.gain"], "b": w[f"{name}.shift"]}, dims={"nI": out}), node(at + 2, "maxout>>layernorm", children=[at, at + 1])]
    nodes.append(node(0, "with_array(residual(expand_window>>maxout>>layernorm))", children=[102 + 3 * k for k in range(1, m.depth + 1)], pad=m.pad))
    component("tok2vec", "tok2vec", nodes)
    for head in heads:
        for r in rules:
            if r.get("before") == head:
                component(r["name"], r["factory"], [], settings=r["settings"])
        if head in ("tag", "senter"):
            name = "tagger" if head == "tag" else "senter"
            out, inputs = w[f"{name}.W"].shape
            component(name, name, [node(0, "tok2vec-listener"), node(1, "softmax", {"W": w[f"{name}.W"], "b": w[f"{name}.b"]}, dims={"nO": out, "nI": inputs})], labels=m.tags if head == "tag" else ["I", "S"], settings={"overwrite": False})
        else:
            name = "parser" if head == "parse" else "ner"
            features, outputs, pieces, inputs = w[f"{name}.lower.W"].shape
            linear = lambda k, part: node(k, "linear", {"W": w[f"{name}.{part}.W"], "b": w[f"{name}.{part}.b"]}, dims=dict(zip(("nO", "nI"), w[f"{name}.{part}.W"].shape)))  # noqa: E731, B023
            upper = linear(4, "upper") if f"{name}.upper.W" in w else node(4, "noop")
            moves = [k if k in ("S", "D", "O") else f"{k}-{x}" for k, x in (m.parser if head == "parse" else m.entities)]
            component(name, name, [node(0, "parser_model", refs={"tok2vec": 1, "lower": 3, "upper": 4}), node(1, "listener>>linear", children=[5, 2]), linear(2, "project"), node(3, "precomputable_affine", {"W": w[f"{name}.lower.W"], "b": w[f"{name}.lower.b"], "pad": w[f"{name}.lower.pad"][None]}, dims={"nF": features, "nO": outputs, "nP": pieces, "nI": inputs}), upper, node(5, "tok2vec-listener")], moves=moves, labels=sorted({x for _, x in (m.entities if head == "ner" else m.parser) if x}))
    for r in rules:
        if r.get("before") not in heads:
            component(r["name"], r["factory"], [], settings=r["settings"])
    manifest = {"format_version": FORMAT, "source": {"spacy_version": "", "model_name": "synthetic", "model_version": "1", "lang": lang}, "runtime": {"min_runtime_version": "0", "requires_python": False}, "tokenizer": {"kind": "regex", "path": "tokenizer.json"}, "pipeline": pipeline}
    if m.static:
        keys, rows, vectors, _ = m.static
        for name, t in (("v.data", vectors), ("v.keys", keys), ("v.rows", rows.astype(np.uint64))):
            tensors[name] = t
        manifest["vectors"] = {k: {"key": f"v.{k}", "dtype": "F32" if k == "data" else "U64", "shape": list(tensors[f"v.{k}"].shape)} for k in ("data", "keys", "rows")}
    save(root, manifest, tensors, tokenizer.dump())
