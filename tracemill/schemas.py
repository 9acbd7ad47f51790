"""Schemas of the domain tables. Every reader declares its schema; none is inferred."""

from pyspark.sql.types import StructType

READS = "readid string, signalid string, seq string, qs double, ns int, ts int, sp int, raw_file string, shift double, scale double, mv array<tinyint>"
SIGNALS = "raw_file string, signalid string, adc array<smallint>, pa array<float>"
KMER_MODEL = "kmer string, level_mean double, level_stdv double"
SEGMENTS = "readid string, signalid string, start int, end int, basepos int, base string, motif string, state string, posterior_probability double, polish string"
SEGMENT_ERRORS = "readid string, signalid string, error string, T int, N int"
MOVES = "readid string, signalid string, position int, base string, motif string, start int, end int"
EVENTALIGN = (
    "contig string, position int, reference_kmer string, read_index int, strand string, event_index int, event_level_mean double, event_stdv double, "
    "event_length double, model_kmer string, model_mean double, model_stdv double, standardized_level double, start_idx int, end_idx int"
)
RESQUIGGLE = "read_id string, kmer_idx string, start_raw_idx string, end_raw_idx string"
DTW = (
    "seq_name string, seq_pos int, seq_strand string, aln_id string, seq_kmer string, aln_read_id string, dtw_start string, dtw_length string, "
    "dtw_current string, dtw_current_sd string"
)
PARAM_OBS = "param string, seq_no long, value double"


def schema(text: str) -> StructType:
    """The struct type of a schema written as text."""
    return StructType.fromDDL(text)
