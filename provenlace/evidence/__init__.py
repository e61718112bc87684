"""Evidence graphs as tables: state folded from the log, checks of evidence sets, and checks of commits."""
