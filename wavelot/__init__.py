"""wavelot: speech and text dataset preparation on Spark DataFrames."""

from importlib import import_module

_WHERE = {
    "Loader": "wavelot.plans.loader", "Dataset": "wavelot.plans.loader", "LoaderOptions": "wavelot.options", "Batching": "wavelot.options",
    "BuildOptions": "wavelot.options", "build": "wavelot.plans.build", "list_existing": "wavelot.plans.build",
    **dict.fromkeys(("extractor", "features", "Fbank", "WhisperFbank", "KaldiFbank", "SpecAugment", "spec_augment", "spec_augment_batch", "time_warp", "time_warp_batch"), "wavelot.functions.features"),
    "Augment": "wavelot.options", "stream_batches": "wavelot.streaming.batcher", "index_tars": "wavelot.sources.tarindex", "read_ranges": "wavelot.sources.tarindex", "AudioTar": "wavelot.sources.audiotar",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    # looked up when first used, so that Python workers don't import all of it
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(_WHERE[name]), name)
