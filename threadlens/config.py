"""Corpus configuration and the fixed values shared with the published results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values (must equal the published setup) -------------------------------------------
ANALYSIS_THRESHOLD = 0.35
MISSING_CONTEXT = ("", "0", "[]")
NO_CONTEXT = "0_no_context"

TOPICS = [
    "xenophobia", "suffering", "economic", "migration", "culture",
    "benefits", "health", "security", "dehumanisation", "others",
]
IMPLICIT_CATEGORIES = [
    "Context", "Entailment/Evaluation", "Extrapolation", "Figures of speech", "Humor/Jokes",
    "Imperative/Exhortative", "Irony/Sarcasm", "World knowledge", "Others",
]
MODEL_NAMES = {"beto": "BETO", "roberta_bne": "MarIA", "bertin": "BERTIN", "mbert": "M-BERT"}
CONTEXT_NAMES = {
    "0_no_context": "No Context",
    "1_previous_sentences": "Level 1",
    "2_previous_comment": "Level 2",
    "3_first_comment": "Level 3",
    "4_news_title": "News Title",
    "5_concat_contexts": "Concatenated Contexts",
    "2_txt_father": "Level 2",
    "3_txt_head": "Level 3",
    "4_rh_text": "Racial Hoax",
    "stereo_father": "Father Stereotype",
    "stereo_head": "Head Stereotype",
    "model": "Model",
}
METRIC_NAMES = {
    "f1_neg": "$F_1$\nNegative Class",
    "f1_pos": "$F_1$\nPositive Class",
    "accuracy_explicit": "Accuracy\nExplicit",
    "accuracy_implicit": "Accuracy\nImplicit",
    "accuracy_no_contextual": "Accuracy\nNonContextual",
    "accuracy_contextual": "Accuracy\nContextual",
    "roc_auc": "Roc AUC",
    "accuracy": "Accuracy",
    "precision_neg": "Precision\nNegative Class",
    "recall_neg": "Recall\nNegative Class",
    "precision_pos": "Precision\nPositive Class",
    "recall_pos": "Recall\nPositive Class",
    "softmax_confidence": "Confidence",
    "TP_softmax_confidence": "TP Confidence",
    "FP_softmax_confidence": "FP Confidence",
    "FN_softmax_confidence": "FN Confidence",
    "TN_softmax_confidence": "TN Confidence",
}
# Model-label clean-up chain applied, in this order, after dropping "<data>-" and title-casing.
MODEL_LABEL_REPLACEMENTS = [
    ("Svc", "SVC"),
    ("Tfidf", "TFIDF"),
    ("_", " "),
    ("-", " - "),
    ("+", " + "),
    (" gram", "-gram"),
    ("knn ", "k-nn, k="),
    ("Lr", "LR "),
    ("E - ", "e-"),
    ("S42", ""),
    ("Ep20", ""),
]
# Change labels of the context-effect analysis.
WORSE_FP, BETTER_TN, WORSE_FN, BETTER_TP = "empeora (FP)", "mejora (TN)", "empeora (FN)", "mejora (TP)"
SAME_AS_FATHER = "igual al father"


@dataclass(frozen=True)
class CorpusConfig:
    """Static description of one corpus: keys, text, target and context order (nearest -> farthest)."""

    data: str
    key_cols: list[str]
    text_col: str
    target: str
    contexts: list[str]
    contexts_results: list[str]
    text_columns: list[str]
    topics: list[str] = field(default_factory=lambda: list(TOPICS))
    implicit_categories: list[str] = field(default_factory=lambda: list(IMPLICIT_CATEGORIES))

    @property
    def target_pred(self) -> str:
        return self.target + "_pred"

    @property
    def y_columns(self) -> list[str]:
        return [self.target] + self.topics

    def with_keys(self, *keys: str) -> "CorpusConfig":
        return replace(self, key_cols=list(keys))


STEREOHOAX = CorpusConfig(
    data="stereohoax",
    key_cols=["index"],
    text_col="text",
    target="stereo",
    contexts=["txt_father", "txt_head", "rh_text"],
    contexts_results=["0_no_context", "2_txt_father", "3_txt_head", "4_rh_text", "5_concat_contexts"],
    text_columns=["text", "txt_father", "txt_head", "rh_text"],
)
DETESTS = CorpusConfig(
    data="detests",
    key_cols=["comment_id", "sentence_pos"],
    text_col="sentence",
    target="stereotype",
    contexts=["previous_sentences", "previous_comment", "first_comment", "news_title"],
    contexts_results=[
        "0_no_context", "1_previous_sentences", "2_previous_comment",
        "3_first_comment", "4_news_title", "5_concat_contexts",
    ],
    text_columns=["sentence"],
)


def get_conf(data: str) -> CorpusConfig:
    name = data.lower()
    if name == "stereohoax":
        return STEREOHOAX
    if name == "detests":
        return DETESTS
    raise ValueError("Data must be 'detests' or 'stereohoax'")
