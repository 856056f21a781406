"""Operators over texts for language-model training data. The core imports none of them."""
