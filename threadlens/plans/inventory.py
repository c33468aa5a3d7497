"""SURVEY §2 operator id -> registered query names (used by the README table and a coverage test)."""

INVENTORY: dict[str, list[str]] = {
    "S1": ["read_corpus"], "S2": ["read_news"], "S3": ["read_predictions", "evaluate_runs"], "S4": ["parse_run"],
    "S5": ["write_predictions"], "S6": ["write_metrics"], "S7": ["write_splits"], "S8": ["write_analysis"],
    "S9": ["incremental_files"],
    "P1": ["normalise_thread_ids"], "P2": ["assert_no_nulls"], "P3": ["model_view"], "P4": ["drop_missing_context"],
    "P5": ["drop_context_equal_text"], "P6": ["refill_context_equal_text"], "P7": ["debug_context"],
    "P8": ["append_context"], "P9": ["filter_runs"], "P10": ["display_names"], "P11": ["clean_model_label"],
    "P12": ["mark_same_context"], "P13": ["stack_contexts"],
    "J1": ["add_news"], "J2": ["comment_table"], "J3": ["add_parent_text"], "J4": ["add_root_text", "context_columns"],
    "J5": ["find_root"], "J6": ["thread_components"], "J7": ["join_gold"], "J8": ["enrich_test"],
    "J9": ["add_parent_labels"], "J10": ["add_comment_label_arrays"], "J11": ["rejoin_gold_after_avg"],
    "J12": ["split_by_groups"], "J13": ["attach_annotations"],
    "A1": ["label_distribution"], "A2": ["group_sizes", "n_groups", "group_share"], "A3": ["split_balance"],
    "A4": ["group_value_counts"], "A5": ["class_weights"], "A6": ["seed_average_hard"], "A7": ["seed_average_soft"],
    "A8": ["seed_summary"], "A9": ["welch_test", "welch_pvalue"], "A10": ["min_max_norm"], "A11": ["union_metrics"],
    "A12": ["metrics_long_to_wide"],
    "W1": ["previous_sentences"], "W2": ["previous_sentence"], "W3": ["last_sentence"], "W4": ["batch_groups"],
    "W5": ["beats_reference"], "W6": ["is_best"], "W7": ["top_k_runs"],
    "O1": ["rank_splits"], "O2": ["shuffle"], "O3": ["sort_by_key"],
    "U1": ["common_changed_items"], "U2": ["concat_runs"], "U3": ["split_group_sets"],
    "F1": ["mask"], "F2": ["split_hashtags"], "F3": ["drop_short_words"], "F4": ["squeeze_repeats"],
    "F5": ["strip_punctuation"], "F6": ["demojize"], "F7": ["squeeze_spaces"], "F8": ["preprocess"],
    "F9": ["tokens_without_stopwords", "lemmatize"], "F10": ["clean_corpus", "clean_corpus_tokens"], "F11": ["soft_label"], "F12": ["fill_context"],
    "F13": ["missing_context_report"], "F14": ["softmax_confidence", "softmax_confidence_scaled"],
    "F15": ["threshold_soft"], "F16": ["agreement"], "F17": ["pct_change_label", "add_change_pct"],
    "M1": ["candidate_group_splits"], "M2": ["score_group_splits"], "M3": ["group_disjoint_split"],
    "M4": ["stratified_split", "iterative_split"], "M5": ["tfidf", "tfidf_3gram"], "M6": ["linear_svc"], "M7": ["mean_word_vectors"],
    "M8": ["constant_baseline"], "M9": ["weighted_random_baseline"], "M10": ["baseline_suite"], "M11": ["batch_score", "batch_score_pairs"],
    "E1": ["confusion"], "E2": ["metrics1"], "E3": ["accuracy_by"], "E4": ["accuracy_by_implicit_category"],
    "E5": ["confidence_stats"], "E6": ["soft_metrics"], "E7": ["symmetric_kl"], "E8": ["confidence_prf"],
    "E9": ["bootstrap_ci", "bootstrap_poisson", "bootstrap_soft"], "E10": ["hierarchical_f"], "E11": ["propensity_f"], "E12": ["icm"],
    "E13": ["hierarchical_metrics"], "E14": ["gold_upper_bound", "gold_upper_bound_hierarchical"],
    "E15": ["evaluate_runs", "task1_metrics", "evaluate_runs_task3"], "E16": ["eval_logits_hard", "eval_soft"], "E17": ["nll"],
    "E18": ["focal_loss"], "E19": ["ece"], "E20": ["fit_temperature", "temperature_grid"],
    "C1": ["context_changes", "context_changes_from_averages"], "C2": ["context_analysis"],
    "C3": ["no_context_counts"], "C4": ["change_summary"], "C5": ["add_change_pct"],
    "C6": ["change_attribute_sums"], "C7": ["seed_convergence"],
    "T1": ["stream_evaluate"], "X1": ["metrics_by"],
}
