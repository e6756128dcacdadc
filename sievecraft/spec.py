"""Parameters of a survey or a collection."""

from __future__ import annotations

import hashlib
import json
import secrets
import warnings
from dataclasses import asdict, dataclass, replace
from datetime import datetime

# The date format, the defaults of ``CollectionSpec`` and its limits (threshold 0 to 100, sizes from 1).
DATE_FORMAT = "%Y-%m-%d %H:%M:%S"

# The granularities a distribution can be asked for.
GRANULARITIES = ("year", "quarter", "month")

# The two class labels, also used as folder and file names.
MALWARE = "malware"
CLEANWARE = "cleanware"
CLASSES = (MALWARE, CLEANWARE)


@dataclass(frozen=True)
class CollectionSpec:
    """One set of "bind variables". Dates are UTC wall-clock text and both bounds are inclusive."""

    date_start: str = "2022-04-01 00:00:00"
    date_end: str = "2024-12-01 00:00:00"
    malware_threshold: int = 4
    n_cleanware: int = 1000
    n_malware: int = 500
    google_play_only: bool = True
    random_seed: int | None = 42
    distribution_granularity: str = "year"

    def __post_init__(self) -> None:
        start = datetime.strptime(self.date_start, DATE_FORMAT)
        end = datetime.strptime(self.date_end, DATE_FORMAT)
        if start >= end:
            raise ValueError("date_start must be before date_end")
        # strptime takes '2022-4-1 0:0:0' as well; keep one spelling so that equal specs compare equal.
        object.__setattr__(self, "date_start", start.isoformat(sep=" "))
        object.__setattr__(self, "date_end", end.isoformat(sep=" "))
        if not 0 <= self.malware_threshold <= 100:
            raise ValueError("malware_threshold must be between 0 and 100")
        if self.n_cleanware < 1 or self.n_malware < 1:
            raise ValueError("n_cleanware and n_malware must be at least 1")
        if self.distribution_granularity not in GRANULARITIES:
            warnings.warn(
                f"unknown granularity {self.distribution_granularity!r}, using 'year'", stacklevel=3
            )
            object.__setattr__(self, "distribution_granularity", "year")

    @property
    def year_bounds(self) -> tuple[int, int]:
        return int(self.date_start[:4]), int(self.date_end[:4])

    @property
    def wanted(self) -> dict[str, int]:
        """Requested rows per class."""
        return {MALWARE: self.n_malware, CLEANWARE: self.n_cleanware}

    def with_seed(self) -> CollectionSpec:
        """The spec itself, or a copy with a freshly drawn seed when none is set.

        Draw once and keep the result: the drawn seed is what makes the sample repeatable.
        """
        if self.random_seed is not None:
            return self
        return replace(self, random_seed=secrets.randbelow(2**31))

    def fingerprint(
        self,
        catalog_id: str,
        mode: str,
        on_bad_date: str | None = None,
        keys_unique: bool = False,
        one_per_key: bool = False,
    ) -> str:
        """Key of a stored sample.

        Covers everything that decides *which order* the candidates come in, and not how many are
        taken: a smaller sample is a prefix of a larger one, so both share one stored sample.
        """
        if self.random_seed is None:
            raise ValueError("an unseeded sample has no key; call with_seed() first")
        parts = asdict(self)
        for name in ("n_cleanware", "n_malware", "distribution_granularity"):
            del parts[name]
        parts |= {"catalog_id": catalog_id, "mode": mode}
        parts |= {"on_bad_date": on_bad_date, "keys_unique": keys_unique}
        if one_per_key:
            parts["one_per_key"] = True
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
