"""Jobs over large audio and text corpora, as DataFrame plans."""
