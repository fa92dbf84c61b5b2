"""Readers and writers: CSV, FCS, sample sheets, results and run manifests."""
