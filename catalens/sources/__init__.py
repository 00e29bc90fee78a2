"""Readers and writers: file listings, tag dumps, requests, manifests, reports."""
