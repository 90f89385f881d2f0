"""The queries of this subpackage, and their SQL where SQL can say the same."""
from __future__ import annotations

from . import bpe, decontaminate, fill_middle, hamming, jaccard, licences, mixing, neighbours, parsing, personal, token_files, toxicity, vector_codes

QUERIES = {f.__name__: f for f in (jaccard.op1_ngram_jaccard, hamming.op2_hamming_top_k, token_files.op3_token_files, personal.op4_personal_data, neighbours.op5_embedding_neighbours, mixing.op6_source_mix, licences.op7_licence_scan, toxicity.op8_toxicity_cnn, bpe.op9_bpe_round_trip, parsing.op10_passage_dedup, fill_middle.op11_fill_in_middle, vector_codes.op12_vector_codes, decontaminate.op13_decontaminate)}
SQL = {"op2_hamming_top_k": hamming.SEARCH_SQL, "op7_licence_scan": licences.scan_sql(), "op11_fill_in_middle": fill_middle.FILL_SQL, "op12_vector_codes": vector_codes.codes_sql(), "op13_decontaminate": decontaminate.scan_sql()}
