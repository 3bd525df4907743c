"""Models of the user's own, beside the built-in ones.

A model is a function ``(columns, rp) -> Column``: from the names of the columns that a feed
has and the run's parameters it builds the score as a Spark expression, so it runs inside
the pricing plan like a built-in model (no Python in the executors unless the model itself
brings a UDF). A registered model can be named wherever a built-in one can, and joins the
model grid with every model of the other kind.

    register_pd_model("watchlist", lambda columns, rp: F.when(F.col("industry") == "energy", 0.2).otherwise(0.02),
                      requires=["industry"])
    price_facilities(feed, pd_model="watchlist")
"""

from __future__ import annotations

import contextlib
import re
from dataclasses import dataclass
from typing import Callable, Dict, Iterable, Iterator, Sequence, Tuple

from pyspark.sql import Column

from ..params import LGD_MODEL_DESCRIPTIONS, PD_MODEL_DESCRIPTIONS, RiskParams

Score = Callable[[Sequence[str], RiskParams], Column]
NAME = re.compile(r"[a-z][a-z0-9_]*")


@dataclass(frozen=True)
class Model:
    """A registered model. ``requires``: columns without which it can't be built."""

    name: str
    score: Score
    requires: Tuple[str, ...] = ()
    description: str = ""

    def build(self, columns: Sequence[str], rp: RiskParams) -> Column:
        missing = [c for c in self.requires if c not in columns]
        if missing:
            raise ValueError(f"model {self.name} needs columns that the feed lacks: {missing}")
        built = self.score(columns, rp)
        if not isinstance(built, Column):
            raise TypeError(f"model {self.name} returned {type(built).__name__} and not a Column")
        return built.cast("double")


class Registry:
    """The models of one kind: built-in names, and what the user added, in order."""

    def __init__(self, kind: str, built_in: Iterable[str]):
        self.kind = kind
        self.built_in = tuple(built_in)
        self.own: Dict[str, Model] = {}

    def names(self) -> Tuple[str, ...]:
        return (*self.built_in, *self.own)

    def check(self, name: str) -> str:
        if name not in self.built_in and name not in self.own:
            raise ValueError(f"Unknown {self.kind} model: {name}")
        return name

    def add(self, model: Model, replace: bool = False) -> None:
        if not NAME.fullmatch(model.name):
            raise ValueError(f"a model's name has small letters, digits and underscores, got {model.name!r}")
        if model.name in self.built_in or (model.name in self.own and not replace):
            raise ValueError(f"there is a {self.kind} model {model.name} already")
        self.own[model.name] = model

    def remove(self, name: str) -> None:
        del self.own[name]


PD = Registry("PD", PD_MODEL_DESCRIPTIONS)
LGD = Registry("LGD", LGD_MODEL_DESCRIPTIONS)


def _register(here: Registry, model: Model, replace: bool) -> None:
    before = dict(here.own)
    here.add(model, replace)
    keys = [f"{p}_{l}" for p in PD.names() for l in LGD.names()]
    if len(set(keys)) < len(keys):
        here.own = before
        raise ValueError(f"the name {model.name} would give two model pairs the same key")


def register_pd_model(name: str, score: Score, requires: Iterable[str] = (), description: str = "", replace: bool = False) -> None:
    """``score(columns, rp)`` builds the probability of default. It is used as it is: a model
    that can leave 0..1 clips itself."""
    _register(PD, Model(name, score, tuple(requires), description), replace)


def register_lgd_model(name: str, score: Score, requires: Iterable[str] = (), description: str = "", replace: bool = False) -> None:
    """``score(columns, rp)`` builds the loss given default, used as it is."""
    _register(LGD, Model(name, score, tuple(requires), description), replace)


def unregister_pd_model(name: str) -> None:
    PD.remove(name)


def unregister_lgd_model(name: str) -> None:
    LGD.remove(name)


@contextlib.contextmanager
def own_models() -> Iterator[None]:
    """What is registered inside is gone afterwards."""
    before = [(r, dict(r.own)) for r in (PD, LGD)]
    try:
        yield
    finally:
        for r, own in before:
            r.own = own
