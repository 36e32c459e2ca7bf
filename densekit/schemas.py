"""Row layouts shared by readers, writers and operators. Ids are BIGINT, ranks start at 1."""

COLLECTION = "id bigint, text string"
QRELS = "qid bigint, iter int, pid bigint, label int"
TRIPLETS = "qid bigint, pos_pid bigint, neg_pid bigint"
RUN = "qid bigint, pid bigint, rk int"
SCORED = "qid bigint, pid bigint, score double"
QUERIES_TSV = "qid bigint, query string"
PASSAGES_TSV = "pid bigint, passage string"
FIRST_STAGE_TSV = "qid bigint, pid bigint, query string, passage string"
EMBEDDINGS = "id bigint, embedding array<float>"
TOKENS = "id bigint, tokens array<int>"
LABELS = "qid bigint, label int"
