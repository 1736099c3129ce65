"""The same operators over streams of samples."""
