"""The pipeline: which stages a configuration makes, in what order, and the entities that come out, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from spanframe.operators import constraints as C
from spanframe.operators import encoder as N
from spanframe.operators import entities as E
from spanframe.operators import ruler as R
from spanframe.operators import sentences as S
from spanframe.operators.regex_tokenizer import Config, tokenizer
from spanframe.sources.bundle import Bundle, BundleError
from spanframe.sources.families import check_family, exported_labels


HEADS = {"tagger": "tag", "parser": "parse", "senter": "senter", "ner": "ner"}


def select_components(components: list[dict], recognizer: bool = True) -> tuple[dict[str, dict], dict | None, list[dict], list[dict]]:
    """What a pipeline's components are for: (components of the heads, the sentencizer, the rulers before the recognizer, those after).

    A recognizer needs one of its kind; of a tagger, a parser, a classifier of sentences and a sentencizer there is at most one,
    and not both of the latter. With a parser no other component says where sentences start.
    """
    by = lambda f: [c for c in components if c["factory"] == f]
    for factory in (*HEADS, "sentencizer"):
        if len(by(factory)) > 1:
            raise BundleError("invalid_component", "component", f"{factory} comes {len(by(factory))} times: {', '.join(c['name'] for c in by(factory))}")
    if recognizer and not by("ner"):
        raise BundleError("missing_component", "component", "there is no recognizer")
    if by("senter") and by("sentencizer"):
        raise BundleError("invalid_component", "component", "several sentence components")
    heads = {HEADS[f]: by(f)[0] for f in HEADS if by(f)}
    at = components.index(by("ner")[0]) if by("ner") else len(components)
    rulers = [(components.index(c) < at, c) for c in by("entity_ruler")]
    if "parse" in heads:
        heads.pop("senter", None)
    rules = by("sentencizer")[0] if by("sentencizer") and "parse" not in heads else None
    return heads, rules, [c for early, c in rulers if early], [c for early, c in rulers if not early]


@dataclass
class Pipeline:
    """tokenize, encode and parse, sentences, rules before, constraints, recognizer, rules after, collect."""

    tokenize: str | Callable = "whitespace"
    config: Config | None = None
    model: N.Model | None = None
    heads: tuple[str, ...] = ()
    terminals: tuple[str, ...] | None = S.PUNCT_CHARS
    before: list[dict] = field(default_factory=list)
    after: list[dict] = field(default_factory=list)
    overwrite: bool = False
    phrase_attr: str = "ORTH"
    #: Rulers of a bundle, which each have their own way of writing; overwrites: the sentence component also says what was said.
    early: list[R.Ruler] = field(default_factory=list)
    late: list[R.Ruler] = field(default_factory=list)
    overwrites: bool = False
    language: str = ""
    #: The bundle's own coarse labels.
    exported: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, b: Bundle, tokenize: Callable | None = None, recognizer: bool = True) -> Pipeline:
        """The pipeline that a bundle describes. tokenize: a function of documents to a flat token table in place of the bundle's
        tokenizer, as dictionary analysers need it; recognizer: False also takes bundles without one, as for tags alone."""
        from spanframe.plans import load

        language, kind = b.manifest["source"]["lang"], b.manifest["tokenizer"]["kind"]
        if language not in ("en", "ja"):
            raise BundleError("unsupported_language", "language", f"no pipeline for {language!r}", item=language)
        heads, rules, early, late = select_components(b.manifest["pipeline"], recognizer)
        config = load.config(b) if kind == "regex" and tokenize is None else None
        if tokenize is None:
            try:
                tokenize = tokenizer(kind, config)
            except ValueError as e:
                raise BundleError("tokenizer_backend_disabled", "tokenizer", str(e), item=kind) from e
        if "senter" in heads and heads["senter"]["labels"] != ["I", "S"]:
            raise load.wrong(heads["senter"], "a sentence classifier's labels are I and S")
        said = heads.get("senter") or rules
        marks = load.setting(rules, "punct_chars", list) if rules else None
        # The order in which heads write is theirs; the recognizer comes after the rules.
        order = [h for h in ("tag", "senter", "parse", "ner") if h in heads]
        return cls(tokenize, config, load.model(b, {h: heads[h] for h in order}), tuple(order), tuple(marks) if marks is not None else None, early=[load.ruler(c) for c in early], late=[load.ruler(c) for c in late], overwrites=load.setting(said, "overwrite", bool) if said else False, language=language, exported=exported_labels(b.manifest))

    @classmethod
    def english(cls, b: Bundle, heads: tuple[str, ...] = ("tag", "parse", "ner"), tokenize: Callable | None = None) -> Pipeline:
        """These heads of an English bundle, all of which it must have, and no rules; ("tag",) is the tagger alone."""
        if b.manifest["source"]["lang"] != "en":
            raise BundleError("unsupported_language", "language", f"the pipeline's language is en, not {b.manifest['source']['lang']!r}", item=b.manifest["source"]["lang"])
        p = cls.load(b, tokenize, "ner" in heads)
        for h in heads:
            if h not in p.heads:
                raise BundleError("missing_component", "component", f"there is no component for {h}", item=h)
        return replace(p, heads=tuple(h for h in p.heads if h in heads), terminals=None, early=[], late=[])

    @classmethod
    def japanese(cls, b: Bundle, tokenize: Callable) -> Pipeline:
        """A standard bundle of the Japanese family, with the coarse labels it exports. tokenize: its dictionary analyser."""
        check_family(b.manifest)
        return cls.load(b, tokenize)

    def __post_init__(self):
        if ("parse" in self.heads or "ner" in self.heads or "tag" in self.heads) and self.model is None:
            raise ValueError("a tagger, a parser or a recognizer needs a model")
        self.boundary = S.choose("parse" in self.heads, "senter" in self.heads, self.terminals is not None and "senter" not in self.heads)

    def stages(self) -> list[str]:
        """The plan, by name; stages whose result nothing needs aren't in it."""
        out = ["tokenize", *(["encode"] if self.heads else []), *([] if self.boundary in ("parser", "classifier") else ["sentences"]), *(["rules before"] if self.before or self.early else []), "constraints", *(["recognize"] if "ner" in self.heads else []), *(["rules after"] if self.after or self.late else []), "collect"]
        return out

    def labels(self) -> list[str]:
        """The labels that can come out, in order."""
        own = (self.model.labels or [x for _, x in self.model.entities if x]) if self.model and "ner" in self.heads else []
        return list(dict.fromkeys([*own, *R.labels(self.before), *(x for r in (*self.early, *self.late) for x in R.labels(r.patterns)), *R.labels(self.after)]))

    def supports(self, label: str) -> bool:
        return label in self.labels()

    def process(self, docs: DataFrame, constraints: DataFrame | None = None, tokens_only: bool = False) -> DataFrame:
        """The annotated flat token table of (doc_id, text, lang?); tokens_only: as the rules after all else find it."""
        make = tokenizer(self.tokenize, self.config) if isinstance(self.tokenize, str) else self.tokenize
        t = make(docs)
        early = tuple(h for h in self.heads if h != "ner")
        if early:
            t = N.annotate(t, self.model, early, self.overwrites)
        if self.boundary == "rules":
            t = S.sentence_starts(t, self.terminals, self.overwrites)
        elif self.boundary == "first":
            t = S.document_start(t)
        if tokens_only:
            return t
        if self.before:
            t = R.annotate(t, self.before, self.overwrite, self.phrase_attr)
        for r in self.early:
            t = r.annotate(t)
        if constraints is not None:
            t = C.apply(t, constraints)
        if "ner" in self.heads:
            t = N.annotate(t, self.model, ("ner",))
        if self.after:
            t = R.annotate(t, self.after, self.overwrite, self.phrase_attr)
        for r in self.late:
            t = r.annotate(t)
        return R.with_entities(t)

    def extract(self, docs: DataFrame, labels: list[str] | None = None, constraints: DataFrame | None = None) -> DataFrame:
        """Entities, one a row. A batch is the table; documents don't touch each other."""
        if self.after and not (self.heads or self.before or self.early or self.late) and constraints is None:
            # Rules alone: their matches are all there is, so no token table is written.
            return R.extract(self.process(docs, tokens_only=True), self.after, self.phrase_attr, labels)
        return E.collect(self.process(docs, constraints), labels)

    def people(self, docs: DataFrame) -> DataFrame:
        return self.extract(docs, ["PERSON"])

    def coarse(self, docs: DataFrame, exported: dict[str, str] | None = None) -> DataFrame:
        return E.fine_to_coarse(self.extract(docs), self.exported if exported is None else exported)

    def token_labels(self, docs: DataFrame, mapping: dict[str, str] | None = None, fallback: str | None = None) -> DataFrame:
        return E.token_labels(self.process(docs), mapping, fallback)
