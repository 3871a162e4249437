"""The tables' fixed schemas."""

SHARDS = "dataset string, audio_tar string, manifest string, hours double, num_samples long"
MANIFEST = "audio_filepath string, text string, duration double"
SAMPLES = "dataset string, url string, key string, ext string, audio array<float>, sample_rate int, length_s double, error string"
TAR_ENTRIES = "url string, key string, ext string, bytes binary"
TAR_INDEX = "url string, place long, key string, ext string, offset long, size long, packed boolean, frames long, rate long, error string"
SOURCES = "id string, audio_path string, text string, start double, duration double, slice_audio boolean"
#: What stands for a missing or blank transcript.
EMPTY_TEXT = "<|EMPTY|>"
#: Audio formats by their file name's last part, in the order in which they are looked for.
LABELLED_FORMATS = ("flac", "wav", "mp3")
NOISE_FORMATS = ("wav", "flac", "mp3")
