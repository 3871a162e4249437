"""Options of the loader and the shard builder, checked when they are made."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Augment:
    """Random changes of audio. Probabilities lie in 0..1, levels are in dB, speeds are ratios of output to input length."""

    noise: bool = False
    noise_prob: float = 0.5
    noise_snr_db: tuple[float, float] = (10.0, 20.0)
    speed: bool = False
    speeds: tuple[float, ...] = (0.9, 1.0, 1.1)
    volume: bool = False
    volume_prob: float = 0.5
    volume_db: tuple[float, float] = (-10.0, 6.0)

    def __post_init__(self):
        for p in (self.noise_prob, self.volume_prob):
            if not 0 <= p <= 1:
                raise ValueError("a probability lies between 0 and 1")
        for lo, hi in (self.noise_snr_db, self.volume_db):
            if lo > hi:
                raise ValueError("a range's lower end comes first")
        if not self.speeds or min(self.speeds) <= 0:
            raise ValueError("speeds are positive")


@dataclass(frozen=True)
class Batching:
    """How samples become batches. Lengths and the budget are in seconds; budgets count padding."""

    max_duration: float | None = 600.0
    max_samples: int | None = None
    batch_size: int | None = None
    min_length: float = 0.1
    max_length: float = 60.0
    num_buckets: int = 30
    intra_batch_mux: bool = True
    num_copies: int = 1
    drop_tail: bool = False

    def __post_init__(self):
        if self.max_duration is None and self.batch_size is None:
            raise ValueError("give max_duration or batch_size")
        if self.num_copies < 1 or self.num_buckets < 1:
            raise ValueError("num_copies and num_buckets are 1 at least")
        if self.min_length > self.max_length:
            raise ValueError("min_length is above max_length")
        if self.batch_size is not None and self.batch_size < self.num_copies:
            raise ValueError("batch_size is below num_copies")

    @property
    def budget(self) -> float | None:
        """Seconds for one copy of each sample."""
        return None if self.max_duration is None else self.max_duration / self.num_copies

    @property
    def cap(self) -> int | None:
        """Samples in a batch at most, one copy of each."""
        most = self.max_samples if self.max_samples is not None else None if self.max_duration is None else int(self.max_duration)
        return None if most is None else max(1, most // self.num_copies)

    @property
    def rows(self) -> int | None:
        return None if self.batch_size is None else self.batch_size // self.num_copies

    @property
    def buckets(self) -> int:
        return 1 if self.batch_size is not None else self.num_buckets


@dataclass(frozen=True)
class LoaderOptions:
    """passes: how often an epoch goes through each dataset; None: as often as its number of batches takes. world_size and rank: None takes them from the environment of a
    launcher (WORLD_SIZE and RANK), else 1 and 0."""

    batching: Batching = field(default_factory=Batching)
    augment: Augment = field(default_factory=Augment)
    sample_rate: int = 16000
    feature_type: str | None = "Fbank"
    seed: int = 1015
    workers: int = 4
    world_size: int | None = None
    rank: int | None = None
    fill_factor: float = 1.15
    passes: int | None = None
    is_test: bool = False
    weights: tuple[float, ...] | None = None

    def __post_init__(self):
        for name, default in (("world_size", "1"), ("rank", "0")):
            if getattr(self, name) is None:
                object.__setattr__(self, name, int(os.environ.get(name.upper(), default)))
        if not 0 <= self.rank < self.world_size:
            raise ValueError("rank lies below world_size")
        if self.workers < 1 or (self.passes is not None and self.passes < 1):
            raise ValueError("workers and passes are 1 at least")
        if self.weights is not None and (min(self.weights) < 0 or not sum(self.weights)):
            raise ValueError("weights aren't negative and not all 0")


@dataclass(frozen=True)
class BuildOptions:
    """Exactly one of num_tars, samples_per_tar and duration_per_tar (hours); balance_by goes with num_tars.

    sample_rate: None keeps each source's rate; tmp_dir: where plans are stored, by default in output_dir; workers: shards written at a time, by default as
    many as the cluster takes; wave: shards that are committed together."""

    input: str
    output_dir: str = "data/tars"
    num_tars: int | None = None
    samples_per_tar: int | None = None
    duration_per_tar: float | None = None
    balance_by: str = "duration"
    format: str = "FLAC"
    sample_rate: int | None = None
    seed: int = 42
    split_bits: int = 8
    tar_prefix: str | None = None
    no_lst: bool = False
    plan_only: bool = False
    split_start: int | None = None
    split_end: int | None = None
    compression_level: float = 0.65  # of MP3
    tmp_dir: str | None = None
    workers: int | None = None
    wave: int = 4096

    def __post_init__(self):
        given = [x for x in (self.num_tars, self.samples_per_tar, self.duration_per_tar) if x is not None]
        if len(given) != 1:
            raise ValueError("give exactly one of num_tars, samples_per_tar and duration_per_tar")
        if given[0] <= 0:
            raise ValueError("the size of the plan is positive")
        if self.balance_by not in ("samples", "duration"):
            raise ValueError("balance_by is samples or duration")
        if self.format.upper() not in ("FLAC", "MP3", "WAV"):
            raise ValueError("format is FLAC, MP3 or WAV")
        if self.wave < 1 or (self.workers is not None and self.workers < 1):
            raise ValueError("wave and workers are 1 at least")

    @property
    def plan_folder(self) -> str:
        return (self.tmp_dir or self.output_dir).rstrip("/")

    @property
    def by_duration(self) -> bool:
        return self.duration_per_tar is not None or (self.num_tars is not None and self.balance_by == "duration")

    @property
    def prefix(self) -> str:
        if self.tar_prefix:
            return self.tar_prefix
        name = self.input.rstrip("/").rsplit("/", 1)[-1]
        return name.removesuffix(".gz").removesuffix(".tsv")
