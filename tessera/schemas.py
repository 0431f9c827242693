"""Explicit schemas of the file formats."""

CORPUS = "`_id` string, text string"
QUERIES = "`_id` string, text string"
QRELS = "`query-id` string, `corpus-id` string, score int"
SCORED_RUN = "qid string, results array<array<string>>"
EXPANSION = "qid string, expansion string, error string"
AUGMENTATION = "id string, contents string"
ARTICLE_PAIRS = "article_id_before string, text_before string, text_after string"
TRIPLES = "qid string, positive_doc_id string, hard_negative_doc_id string"
CELL = (
    "model string, task string, lang string, split string, n_queries bigint,"
    " metrics map<string,double>, per_query map<string,map<string,double>>"
)
TRAIN_CONFIG = "model string, task string, lang string, output_alias string, tuning_method string"
EPOCHS = "epoch int, step int, train_loss double, val_loss double, lr double, best boolean, bad_epochs int"

TASKS = ("rat2rev", "rev2rev")
LANGS = ("en", "ja")
SPLITS = ("train", "validation", "test")
