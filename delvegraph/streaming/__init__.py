"""Extensions: an index that follows its inputs (no counterpart among the batch operators)."""
