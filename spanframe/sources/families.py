"""What families of model bundles ask for beyond a sound manifest: their language, tokenizer, transformer and dictionary settings."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields
from pathlib import Path

from spanframe.operators.entities import COARSE, ONTONOTES
from spanframe.operators.regex_tokenizer import is_safe_path
from spanframe.sources.bundle import REPORT, BundleError, inspect

#: The name that Japanese bundles of this family have in that of their model.
FAMILY = "ginza"


def has_transformer(manifest: dict) -> bool:
    return any("transformer" in c["factory"] for c in manifest["pipeline"])


def model_family(manifest: dict) -> str:
    """standard or electra, the latter by the model's name or by a transformer among the components."""
    source = manifest["source"]
    if source["lang"] != "ja":
        raise BundleError("unsupported_language", "language", f"the family's language is ja, not {source['lang']!r}", item=source["lang"])
    name = source["model_name"].replace("-", "_")
    if FAMILY not in name:
        raise BundleError("unsupported_model", "manifest", f"{source['model_name']!r} isn't of this family", item=source["model_name"])
    return "electra" if "electra" in name or has_transformer(manifest) else "standard"


def check_family(manifest: dict, electra: bool = False) -> None:
    """A standard bundle can't be run as one with a transformer, nor the other way round; both are cut by the dictionary analyser."""
    if (model_family(manifest) == "electra") != electra:
        raise BundleError("transformers_required", "component", "a bundle with a transformer and one without have pipelines of their own")
    kind = manifest["tokenizer"]["kind"]
    if kind != "sudachi":
        raise BundleError("unsupported_tokenizer", "tokenizer", f"the family's tokenizer is sudachi, not {kind!r}", item=kind)


def exported_labels(manifest: dict) -> dict[str, str]:
    """The coarse labels that a recognizer's own mapping gives; a fine label with a meaning of its own keeps it."""
    out = {}
    for c in manifest["pipeline"]:
        mappings = c.get("settings", {}).get("label_mappings") if c["factory"] == "ner" else None
        mapping = mappings.get("ontonotes") if isinstance(mappings, dict) else None
        for label, to in (mapping if isinstance(mapping, dict) else {}).items():
            coarse = COARSE.get(label) or (to if isinstance(to, str) and to in ONTONOTES else None)
            if isinstance(to, str) and coarse:
                out[label] = coarse
    return out


def split_mode(value: str | None = None) -> str:
    """A, B or C, also in small letters; A if nothing is said."""
    mode = (value if value is not None else "A").upper()
    if mode not in ("A", "B", "C"):
        raise BundleError("invalid_split_mode", "tokenizer", f"no split mode {value!r}", item=value)
    return mode


def inside(root: str | Path, path: str) -> Path:
    """A file in a bundle; neither its name nor a link may lead out of it."""
    at, root = Path(root) / path, Path(root).resolve()
    if not is_safe_path(path) or not at.resolve().is_relative_to(root):
        raise BundleError("unsafe_path", "file", f"{path!r} leads out of the bundle", item=path)
    if not at.is_file():
        raise BundleError("missing_file", "file", f"{path} is missing", item=path)
    return at


def check_dictionary(root: str | Path, config: dict) -> Path:
    """The dictionary of an analyser's configuration, once that is found sound."""

    def wrong(code: str, message: str, item: str | None = None) -> BundleError:
        return BundleError(code, "tokenizer", message, item=item)

    if config.get("format_version") != 1:
        raise wrong("unsupported_format", f"the configuration's version is {config.get('format_version')!r}, not 1")
    if config.get("language") != "ja":
        raise wrong("invalid_language", f"the configuration's language is {config.get('language')!r}, not 'ja'")
    if not config.get("max_grouping_len"):
        raise wrong("invalid_max_grouping_len", "max_grouping_len is 0 or missing")
    for rule in config.get("compatibility_rules", []):
        parts = [t["surface"] for t in rule["tokens"]]
        if not parts or not all(parts) or "".join(parts) != rule["text"]:
            raise wrong("invalid_compatibility_rule", f"the parts of {rule['text']!r} don't make it up", rule["text"])
    at = inside(root, config["dictionary_path"])
    expected = config.get("dictionary_sha256")
    if expected:
        with at.open("rb") as f:
            actual = hashlib.file_digest(f, "sha256").hexdigest()
        if actual != expected.lower():
            raise wrong("dictionary_checksum", f"the dictionary's SHA-256 is {actual}, not {expected}", config["dictionary_path"])
    if "空白" not in config.get("tag_map", {}):
        raise wrong("missing_pos", "there is no tag for white space", "空白")
    return at


@dataclass(frozen=True)
class TransformerTokenizer:
    kind: str
    split_mode: str
    word_form_type: str
    do_lower_case: bool
    do_nfkc: bool
    cls_token: str
    sep_token: str
    unk_token: str
    pad_token: str


@dataclass(frozen=True)
class TransformerSpec:
    architecture: str
    model: str
    hidden_width: int
    window: int
    stride: int
    max_wordpieces: int
    config_path: str
    weights_path: str
    vocab_path: str
    tokenizer: TransformerTokenizer

    @classmethod
    def load(cls, root: str | Path, manifest: dict) -> TransformerSpec:
        """That of the one transformer that a bundle has."""
        found = [c for c in manifest["pipeline"] if "transformer" in c["factory"]]
        if len(found) != 1:
            raise BundleError("invalid_component" if found else "missing_component", "component", f"{len(found)} transformers: {', '.join(c['name'] for c in found)}")
        return cls.read(root, found[0]["settings"])

    @classmethod
    def read(cls, root: str | Path, settings: dict) -> TransformerSpec:
        spec = cls(**{**_typed(cls, settings), "tokenizer": TransformerTokenizer(**_typed(TransformerTokenizer, settings.get("tokenizer")))})
        spec.check()
        for path in (spec.config_path, spec.weights_path, spec.vocab_path):
            inside(root, path)
        return spec

    def check(self) -> None:
        t, wrong = self.tokenizer, None
        if self.architecture != "electra":
            wrong = f"no architecture {self.architecture!r}"
        elif not self.model:
            wrong = "the model has no name"
        elif self.hidden_width < 1:
            wrong = "hidden_width is 0"
        elif self.window < 1:
            wrong = "window is 0"
        elif not 1 <= self.stride <= self.window:
            wrong = "stride isn't in 1 to window"
        elif self.max_wordpieces < 2:
            wrong = "max_wordpieces has no room for the marks of begin and end"
        elif (t.kind, t.split_mode, t.word_form_type) != ("sudachitra_wordpiece", "A", "dictionary_and_surface"):
            wrong = "word pieces must be those of split mode A, of dictionary and surface forms"
        if wrong:
            raise BundleError("invalid_transformer", "component", wrong)
        for path in (self.config_path, self.weights_path, self.vocab_path):
            if not is_safe_path(path):
                raise BundleError("unsafe_path", "file", f"{path!r} leads out of the bundle", item=path)


def _typed(cls, settings: dict | None) -> dict:
    """The settings that the class has as fields, each of its type; numbers aren't negative. Others are ignored."""
    types, out = {"str": str, "int": int, "bool": bool}, {}
    for f in fields(cls):
        v = (settings or {}).get(f.name)
        kind = types.get(f.type)
        if kind and (type(v) is not kind or kind is int and v < 0):
            raise BundleError("invalid_setting", "component", f"{f.name} is {v!r}, not {f.type}", item=f.name)
        out[f.name] = v
    return out


def gate(spark, root: str | Path, supported: int = REPORT) -> dict:
    """The report on a bundle, as a dict; an error if its version isn't the supported one or the bundle can't be run."""
    report = inspect(spark, root).first().asDict(recursive=True)
    if report["report_version"] != supported:
        raise BundleError("unsupported_report", "manifest", f"the report's version is {report['report_version']}, not {supported}")
    if not report["compatible"]:
        d = report["diagnostics"][0] if report["diagnostics"] else {"code": "unknown", "area": "manifest", "message": "the bundle can't be run", "component": None, "node": None, "item": None}
        raise BundleError(d["code"], d["area"], f"the bundle was rejected [{d['code']}]: {d['message']}", d["component"], d["node"], d["item"])
    return report
