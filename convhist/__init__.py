"""convhist: Spark DataFrame operators over large conversation histories."""
