TRICKY = [None, "", "  \n\t ", "one", "one two three four", "ONE two  three\nfour five", "one two three four five six " * 400,
          "a\nb\na\n\na", "x" * 3000, "é ü\xa0ñ 中文 \x1c| # $", "same same same same same same same same same same", "end\n"]
