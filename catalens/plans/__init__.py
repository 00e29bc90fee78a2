"""Conversion routes, predicted sizes and the tool calls of each missing rendition."""
