"""Column names of the pair table and its derived features."""

SL = "sl"
ID = "id"
SOURCE = "source_sentence"
TARGET = "paraphrased_sentence"

FEATURES = (
    "src_len",
    "tgt_len",
    "src_char_len",
    "tgt_char_len",
    "len_ratio",
    "word_overlap",
    "char_overlap",
    "bn_char_ratio",
)
