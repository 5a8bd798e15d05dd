"""leafmark: DataFrame operators that turn detected page elements into searchable, well-structured sections."""
