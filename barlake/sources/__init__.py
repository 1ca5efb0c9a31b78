"""Readers and writers: motion and heart-rate files, sidecars, vendor exports, velocity logs."""
