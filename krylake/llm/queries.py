"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from krylake.llm import best_fit, embedding_dedup, exact_dedup, langid, lexical_search, licenses, ngram_lm, packing, periodic_runs, pieces, sharding, simhash, toxicity

QUERIES = {"op1_lm_scoring": ngram_lm.query, "op2_simhash": simhash.query, "op3_exact_dedup": exact_dedup.query, "op4_label_sharding": sharding.query, "op5_toxicity": toxicity.query, "op6_sentencepiece": pieces.query, "op7_mixture_packing": packing.query, "op8_embedding_dedup": embedding_dedup.query, "op9_license_scan": licenses.query, "op10_language_id": langid.query, "op11_best_fit_packing": best_fit.query, "op12_periodic_runs": periodic_runs.query, "op13_lexical_search": lexical_search.query}
ORACLES = {"op3_exact_dedup": exact_dedup.SQL, "op13_lexical_search": lexical_search.SQL}
