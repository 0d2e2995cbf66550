"""The whole way in one call: protect, inspect and restore DataFrames of texts, once or over a session.

An ``Engine`` holds what was decided once - packs, stance, policy, rulings, passes, how values are shown.  A
``Session`` ties it to a store of mappings, so that later texts of a scope keep its numbers and any reply of it can be
restored until the session is closed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.errors import BadConfiguration, PolicyViolation
from veilframe.functions.shared import settled
from veilframe.operators import mappings as M
from veilframe.operators import privacy as P
from veilframe.operators import restore as R
from veilframe.operators.rules import ENTITY_TYPES, PACKS, Rule, rules_for
from veilframe.sources.store import MappingStore


@dataclass(frozen=True)
class Protected:
    """What protecting gave: texts (scope, turn, status, protected_text, reversible), the mappings that restore them, and
    the decided texts behind them."""

    texts: DataFrame
    mappings: DataFrame
    decided: DataFrame

    def restore(self, replies: DataFrame) -> DataFrame:
        """Replies (scope, response_id, text) with the values put back."""
        return R.restore(replies, self.mappings)

    def required(self) -> DataFrame:
        """The texts; an error if the policy blocks or refuses one of them."""
        if self.texts.where("status <> 'ok'").limit(1).count():
            raise PolicyViolation("the policy lets not all texts leave")
        return self.texts


@dataclass(frozen=True)
class Engine:
    packs: tuple[str, ...] = tuple(PACKS)
    stance: str = "recall_first"
    policy: P.Policy = field(default_factory=P.Policy)
    rules: tuple[Rule, ...] = ()
    never: tuple[str, ...] = ()
    always: tuple[tuple[str, str], ...] = ()
    co_occurrence: bool = True
    secrets: bool = False
    passes: tuple = ()
    stand_ins: bool = False
    style: str = "angle"

    def __post_init__(self):
        rules_for(self.packs, self.stance)
        if self.style not in M.STYLES:
            raise BadConfiguration(f"unknown style {self.style!r}; known: {', '.join(M.STYLES)}")
        if self.policy.uncertain not in ("discard", "refuse"):
            raise BadConfiguration(f"unknown way with uncertain values: {self.policy.uncertain!r}")

    def decide(self, texts: DataFrame) -> DataFrame:
        """Texts (scope, turn, text) with entities and status."""
        rules = [*rules_for(self.packs, self.stance), *self.rules]
        found = P.detect(texts.select("scope", "turn", "text"), rules, co_occurrence=self.co_occurrence, secrets=self.secrets, always=list(self.always), passes=self.passes)
        return P.decide(found, self.policy, self.never)

    def inspect(self, texts: DataFrame) -> DataFrame:
        """(scope, turn, types) of texts: what would not leave as it is.  Nothing is numbered, nothing is refused."""
        return P.inspect(self.decide(texts))

    def _shown(self, mappings: DataFrame, texts: DataFrame) -> DataFrame:
        return M.with_surrogates(mappings.select(*M.COLUMNS), texts) if self.stand_ins else mappings.select(*M.COLUMNS)

    def _protected(self, decided: DataFrame, mappings: DataFrame) -> Protected:
        quoting = P.quoting_scopes(decided)
        out = M.protect(decided, mappings, self.policy, self.style)
        same = F.col("scope").eqNullSafe(F.col("_s")) & F.col("turn").eqNullSafe(F.col("_t"))
        out = out.join(quoting.select(F.col("scope").alias("_s"), F.col("turn").alias("_t")).distinct(), same, "left")
        told = F.when(F.col("_s").isNotNull(), "refused").otherwise(F.col("status"))
        return Protected(out.select("scope", "turn", told.alias("status"), F.when(F.col("_s").isNull(), F.col("protected_text")).alias("protected_text"), "reversible"), mappings, decided)

    def protect(self, texts: DataFrame) -> Protected:
        """Texts (scope, turn, text) as they may leave.  A scope whose name quotes a value of its text is refused."""
        decided = settled(self.decide(texts))
        return self._protected(decided, settled(self._shown(M.allocate(decided), texts)))

    def session(self, store: MappingStore) -> "Session":
        return Session(self, store)

    def report(self) -> dict:
        """What these settings do, without doing any of it: types by action, rules by pack, and what to be warned of."""
        actions: dict[str, list[str]] = {}
        for kind, action in sorted(self.policy.actions().items()):
            actions.setdefault(action, []).append(kind)
        rules = [*rules_for(self.packs, self.stance), *self.rules]
        seen = {r.type for r in rules} | {k for _, k in self.always} | {"TEXT"}
        warnings = []
        if secrets := sorted(k for k, (_, c) in ENTITY_TYPES.items() if c == "SECRET" and k not in actions.get("block", [])):
            warnings.append(f"secrets that are not blocked: {', '.join(secrets)}")
        if actions.get("allow"):
            warnings.append(f"types that leave as they are: {', '.join(actions['allow'])}")
        if blind := sorted(set(ENTITY_TYPES) - seen - {k for p in self.passes for k in getattr(p, "labels", {}).values()}):
            warnings.append(f"types that nothing looks for: {', '.join(blind)}")
        if self.policy.min_confidence > 0 and self.policy.uncertain == "discard":
            warnings.append(f"values below a confidence of {self.policy.min_confidence} leave as they are")
        if self.secrets:
            warnings.append("runs of high entropy are taken for keys, content hashes among them")
        if self.stance == "balanced":
            warnings.append("rules that look for shapes alone are off")
        return {
            "packs": {p: sum(r.pack == p for r in rules) for p in (*self.packs, *(["custom"] if self.rules else []))},
            "stance": self.stance, "actions": actions, "min_confidence": self.policy.min_confidence, "uncertain": self.policy.uncertain,
            "passes": [*(["co_occurrence"] if self.co_occurrence else []), *(["entropy"] if self.secrets else []), *(p.name for p in self.passes), *(["corrections"] if self.always else [])],
            "rulings": {"never": len(self.never), "always": len(self.always)}, "shown": "stand-ins" if self.stand_ins else self.style, "policy_hash": self.policy.digest(), "warnings": warnings,
        }


class Session:
    """Scopes that live over many calls: numbers go on, replies of any call are restored, closing forgets."""

    def __init__(self, engine: Engine, store: MappingStore):
        self.engine, self.store, self.closed = engine, store, False

    def _open(self) -> None:
        if self.closed:
            raise BadConfiguration("the session is closed")

    def protect(self, texts: DataFrame) -> Protected:
        self._open()
        decided = settled(self.engine.decide(texts))
        version = self.store.allocate(decided)
        if self.engine.stand_ins:
            version = self.store.change(lambda m: self._shown(m, texts), "stand-ins")
        return self.engine._protected(decided, self.store.read(version))

    def _shown(self, mappings: DataFrame, texts: DataFrame) -> DataFrame:
        """Mappings with a stand-in for those that have none yet; one that was shown stays."""
        fresh = self.engine._shown(mappings, texts).select("scope", "type", "idx", F.col("surface").alias("_new"))
        return mappings.join(fresh, ["scope", "type", "idx"]).withColumn("surface", F.coalesce("surface", "_new")).drop("_new")

    def inspect(self, texts: DataFrame) -> DataFrame:
        self._open()
        return self.engine.inspect(texts)

    def restore(self, replies: DataFrame) -> DataFrame:
        self._open()
        return R.restore(replies, self.mappings())

    def stream_restore(self, chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
        """Starts restoring streamed replies (scope, stream_id, seq, chunk, is_last), by the mappings there are now."""
        from veilframe.streaming.restore import restore_stream

        self._open()
        return restore_stream(chunks, self.mappings(), path, checkpoint)

    def mappings(self) -> DataFrame:
        return self.store.read()

    def close(self, scopes: DataFrame | None = None) -> None:
        """Forgets the scopes' mappings, all of them unless named; without any named the session ends."""
        self._open()
        self.store.purge(self.mappings().select("scope") if scopes is None else scopes)
        self.closed = scopes is None


def protect(texts: DataFrame, **settings) -> Protected:
    """``Engine(**settings).protect(texts)``."""
    return Engine(**settings).protect(texts)


def inspect(texts: DataFrame, **settings) -> DataFrame:
    """``Engine(**settings).inspect(texts)``."""
    return Engine(**settings).inspect(texts)

