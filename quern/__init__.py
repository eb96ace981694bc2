"""quern: text and tabular analytics as plain DataFrame -> DataFrame functions."""
