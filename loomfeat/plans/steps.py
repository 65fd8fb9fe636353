"""Steps by name: what a feature may name instead of a function, so that it can be saved and read again."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfeat.functions import categorical, dates, numeric, text

Step = Callable[[Column], Column]
_MADE: dict[str, Callable[..., Step]] = {}


def register(name: str, factory: Callable[..., Step]) -> None:
    """``factory(**options)`` makes the step; a name is taken once."""
    if name in _MADE:
        raise ValueError(f"there is a step {name} already")
    _MADE[name] = factory


def names() -> list[str]:
    return sorted(_MADE)


def create(name: str, **options: object) -> Step:
    """The step with its options; an option that it does not have is refused."""
    if name not in _MADE:
        raise ValueError(f"no such step: {name}")
    unknown = set(options) - set(inspect.signature(_MADE[name]).parameters)
    if unknown:
        raise ValueError(f"{name}: no such option: {sorted(unknown)}")
    return _MADE[name](**options)


def made(step: Step | str | tuple[str, dict] | list) -> Step:
    """A function as it is, a name or (name, options) from the registry."""
    if callable(step):
        return step
    return create(step) if isinstance(step, str) else create(step[0], **step[1])


def chain(*steps: Step | str | tuple[str, dict]) -> Step:
    """One step that applies all in turn."""
    own = [made(s) for s in steps]

    def run(x: Column) -> Column:
        for step in own:
            x = step(x)
        return x

    return run


# one factory an operator; the signature names its options
register("cast", lambda dtype="double": lambda x: x.cast(dtype))
register("zscore", lambda mean, variance: lambda x: numeric.zscore(x, mean, variance))
register("rescale", lambda scale=1.0: lambda x: numeric.rescale(x, scale))
register("bucket", lambda boundaries: lambda x: numeric.bucket(x, boundaries))
register("one_hot", lambda depth: lambda x: numeric.one_hot(x, depth))
register("min_max", lambda least, most, clip=False: lambda x: numeric.min_max(x, least, most, clip))
register("robust", lambda median, iqr: lambda x: numeric.robust(x, median, iqr))
register("periodic", lambda frequency=1.0, phase=0.0: lambda x: numeric.periodic(x, frequency, phase))
register("sparse_snap", lambda eps=numeric.EPS: lambda x: numeric.sparse_snap(x, eps))
for _name, _f in numeric.TRANSFORMS.items():
    if _name in ("box_cox", "yeo_johnson"):
        register(_name, lambda lam=0.5, f=_f: lambda x: f(x, lam))
    else:
        register(_name, lambda f=_f: f)
register("lookup", lambda vocabulary: lambda x: categorical.lookup(x, vocabulary))
register("hash_bucket", lambda bins, salt="": lambda x: categorical.hash_bucket(x, bins, salt))
register("flatten", lambda: F.flatten)
register("clean", lambda stop_words=(): lambda x: text.clean(x, stop_words))
register("tokens", lambda stop_words=(): lambda x: text.tokens(x, stop_words))
register("vectorize", lambda vocabulary, length=35: lambda x: text.vectorize(x, vocabulary, length))
register("multi_hot", lambda vocabulary: lambda x: text.multi_hot(x, vocabulary))
register("ngrams", lambda n=2: lambda x: text.ngrams(x, n))
register("parse_date", lambda: dates.parse)
register("cyclic", lambda fraction_of_year=False: lambda x: dates.cyclic(x, fraction_of_year))
register("season", lambda: dates.season_one_hot)
