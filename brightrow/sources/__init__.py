"""Readers, table loads, exports and partitioned layouts."""
