"""Training-data operators. Nothing else in chronolake imports this subpackage."""
